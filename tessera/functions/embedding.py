"""Embedding models as hooks: loaded once in each worker, applied to batches, of a dimension that a probe tells."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np

_loaded: dict[str, Callable] = {}


class Embedder:
    """A model for images: load() gives a function from a list of RGB arrays to their vectors, one row each.

    load runs once in each Python worker that needs it, so it may read weights or
    pick a device there; the function gets `batch` images at most.  Vectors come out
    as unit vectors of 32-bit floats.
    """

    def __init__(self, load: Callable[[], Callable[[list[np.ndarray]], np.ndarray]], batch: int = 32):
        if batch < 1:
            raise ValueError("a batch holds one image at least")
        self.load, self.batch, self.key = load, batch, uuid.uuid4().hex

    def model(self) -> Callable[[list[np.ndarray]], np.ndarray]:
        if self.key not in _loaded:
            _loaded[self.key] = self.load()
        return _loaded[self.key]

    def vectors(self, images: list[np.ndarray]) -> np.ndarray:
        parts = [np.asarray(self.model()(images[i : i + self.batch]), np.float32) for i in range(0, len(images), self.batch)]
        x = np.vstack(parts) if parts else np.zeros((0, 0), np.float32)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norm > 0, norm, 1)

    @property
    def dimension(self) -> int:
        """Found with a blank image."""
        return int(self.vectors([np.zeros((224, 224, 3), np.uint8)]).shape[1])


def each_image(function: Callable[[np.ndarray], list[float]]) -> Embedder:
    """An Embedder of a function of one image."""
    return Embedder(lambda: lambda images: np.array([function(x) for x in images], np.float32))
