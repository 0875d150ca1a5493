"""Run parameters: defaults, YAML loading and validation with all errors in one message."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, fields

log = logging.getLogger(__name__)

#: Names, defaults, choices and ranges are fixed values: they are the file format that users bring.
CHOICES = {
    "hash_algorithm": {"sha256", "md5"}, "embedding_device": {"auto", "cpu", "cuda"}, "color_space": {"lab", "hsv"}, "log_level": {"DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"},
}
RANGES = {
    "phash_threshold": (0, 64), "dhash_threshold": (0, 64), "embedding_batch_size": (1, None), "similarity_threshold": (0, 1), "faiss_nlist": (1, None), "faiss_nprobe": (1, None),
    "color_n_clusters": (2, None), "color_distance_threshold": (0, None), "max_image_pixels": (1, None),
}


@dataclass(frozen=True)
class Config:
    """Parameters of a run; unknown keys of a file are ignored with a warning.

    embedding_* describe the model for whoever builds the Embedder of a run;
    faiss_use_gpu has no effect, as the search runs on CPUs.
    """

    hash_algorithm: str = "sha256"
    phash_threshold: int = 10
    dhash_threshold: int = 10
    embedding_model: str = "ViT-B-32"
    embedding_pretrained: str = "laion2b_s34b_b79k"
    embedding_device: str = "auto"
    embedding_batch_size: int = 32
    embedding_dimension: int = 512
    similarity_threshold: float = 0.85
    faiss_nlist: int = 100
    faiss_nprobe: int = 10
    faiss_use_gpu: bool = False
    faiss_brute_force_threshold: int = 1000
    similarity_k: int = 10
    use_background_removal: bool = True
    color_n_clusters: int = 5
    color_space: str = "lab"
    color_distance_threshold: float = 25.0
    color_min_pixel_count: int = 100
    confidence_exact: int = 100
    confidence_phash_base: int = 95
    confidence_phash_decay: float = 2.0
    confidence_embedding_base: int = 80
    max_image_pixels: int = 89_478_485
    supported_extensions: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tiff", ".tif")
    random_seed: int = 42
    log_level: str = "INFO"
    log_file: str | None = None

    def errors(self) -> list[str]:
        found = [f"{k} must be one of {sorted(v)}, not {getattr(self, k)!r}" for k, v in CHOICES.items() if getattr(self, k) not in v]
        for key, (low, high) in RANGES.items():
            value = getattr(self, key)
            if value < low or (high is not None and value > high):
                found.append(f"{key} must be at least {low}" + (f" and at most {high}" if high is not None else "") + f", not {value!r}")
        return found


def make_config(values: dict) -> Config:
    """A validated Config; every error is in the one ValueError."""
    known = {f.name for f in fields(Config)}
    for key in sorted(set(values) - known):
        log.warning("unknown parameter %s is ignored", key)
    picked = {k: v for k, v in values.items() if k in known}
    if "supported_extensions" in picked:
        picked["supported_extensions"] = tuple("." + e.lower().lstrip(".") for e in picked["supported_extensions"])
    if isinstance(picked.get("log_level"), str):
        picked["log_level"] = picked["log_level"].upper()
    config = Config(**picked)
    if errors := config.errors():
        raise ValueError("; ".join(errors))
    return config


def set_logging(config: Config) -> None:
    """Log records of the package at the level, and to the file if one is named, that the config gives."""
    logger = logging.getLogger("tessera")
    logger.setLevel(config.log_level)
    if config.log_file and not any(getattr(h, "baseFilename", None) == os.path.abspath(config.log_file) for h in logger.handlers):
        handler = logging.FileHandler(config.log_file, encoding="utf-8")
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        logger.addHandler(handler)


def load_config(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as file:
        loaded = yaml.safe_load(file) or {}
    flat: dict = {}
    for key, value in loaded.items():
        flat |= value if isinstance(value, dict) else {key: value}
    return make_config(flat)
