"""Scalar expressions: digests, bit signatures, vectors, colours, confidence, text and path parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def content_digest(content, algorithm: str = "sha256") -> Column:
    if algorithm not in ("sha256", "md5"):
        raise ValueError(f"hash algorithm {algorithm!r} is neither sha256 nor md5")
    return F.sha2(col(content), 256) if algorithm == "sha256" else F.md5(col(content))


def hamming(a, b) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def to_hex(h) -> Column:
    return F.lower(F.lpad(F.hex(col(h)), 16, "0"))


def from_hex(s) -> Column:
    return F.conv(col(s), 16, -10).cast("bigint")


def pack_bits(flags) -> Column:
    """Up to 64 booleans as one long, the first the most significant."""
    return F.aggregate(col(flags), F.lit(0).cast("bigint"), lambda x, f: F.shiftleft(x, 1).bitwiseOR(F.when(f, 1).otherwise(0).cast("bigint")))


def sign_bits(vector, first: int, n: int = 64) -> Column:
    return pack_bits(F.transform(F.slice(col(vector), first + 1, n), lambda x: x > 0))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(col(v), lambda x: F.when(norm > 0, x / norm).otherwise(x))


def hash_confidence(p, d, base: float = 95, decay: float = 2.0) -> Column:
    """Half-even rounding of base - mean distance * decay, within 0..100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.lit(float(base)) - (col(p) + col(d)) / 2 * F.lit(float(decay)), 0))).cast("int")


def embedding_confidence(similarity, distance, base: float = 85, threshold: float = 18.0) -> Column:
    near = F.greatest(F.lit(0.0), F.lit(1.0) - col(distance) / F.lit(max(1e-6, float(threshold))))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.lit(float(base)) * col(similarity) * (F.lit(0.7) + F.lit(0.3) * near), 0))).cast("int")


def confidence_band(c) -> Column:
    return F.when(col(c) >= 90, "high").when(col(c) >= 70, "medium").otherwise("low")


def rgb_to_lab(r, g, b) -> tuple[Column, Column, Column]:
    """CIE Lab (D65) of 8-bit sRGB. The sRGB transfer curve, its matrix and the D65 white."""

    def linear(c):
        c = col(c) / F.lit(255.0)
        return F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92)

    def f(t):
        return F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3.0))).otherwise(7.787 * t + 16.0 / 116.0)

    lr, lg, lb = linear(r), linear(g), linear(b)
    x = (lr * 0.4124564 + lg * 0.3575761 + lb * 0.1804375) / 0.95047
    y = (lr * 0.2126729 + lg * 0.7151522 + lb * 0.0721750) / 1.0
    z = (lr * 0.0193339 + lg * 0.1191920 + lb * 0.9503041) / 1.08883
    return 116.0 * f(y) - 16.0, 500.0 * (f(x) - f(y)), 200.0 * (f(y) - f(z))


def rgb_to_hsv(r, g, b) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value in 0..1; of equal channels the later one (r, g, b) gives the hue."""
    r, g, b = (col(c) / F.lit(255.0) for c in (r, g, b))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = high - low
    turn = F.when(span == 0, 0.0).when(b == high, (r - g) / span + 4.0).when(g == high, (b - r) / span + 2.0).otherwise((g - b) / span)
    hue = F.when(span == 0, 0.0).otherwise(F.pmod(60.0 * turn, F.lit(360.0)))
    return hue, F.when(high > 0, span / high).otherwise(0.0), high


def delta_e(a: list, b: list) -> Column:
    return F.sqrt(reduce(lambda s, x: s + x, [(col(p) - col(q)) * (col(p) - col(q)) for p, q in zip(a, b, strict=True)]))


def suffix(path) -> Column:
    return F.lower(F.regexp_extract(col(path), r"(\.[^./]+)$", 1))


def base_name(path) -> Column:
    return F.regexp_extract(col(path), r"([^/]*)$", 1)


#: Fixed value: the endings that views and copies of one model add to its name.
VIEW_MARKS = r"(?i)(_[0-9]+|_angle[0-9]+|_view[0-9]+|_original.*|\s*\([0-9]+\))$"


def model_stem(name) -> Column:
    """A file stem without a trailing view number, angle, `original` or copy mark."""
    return F.trim(F.lower(F.regexp_replace(col(name), VIEW_MARKS, "")))


def category_prefix(name) -> Column:
    found = F.regexp_extract(col(name), r"^([a-zA-Z_]+)_model_", 1)
    return F.when(found == "", "item").otherwise(found)


def group_folder(group_id, category) -> Column:
    return F.format_string("group_%04d_%s", col(group_id), col(category))


def keyword_class(text, classes: dict[str, list[str]], default: str = "other") -> Column:
    """The first class one of whose keywords occurs."""
    low = F.lower(col(text))
    out = None
    for name, words in classes.items():
        hit = reduce(lambda a, b: a | b, [low.contains(w) for w in words])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default) if out is not None else F.lit(default)


#: The forms of file-sharing links, with the id as group 1; whether the host must stand before; whether it is a folder.
DRIVE_LINKS = (
    (r"drive\.google\.com/drive/folders/([a-zA-Z0-9_-]+)", True),
    (r"drive\.google\.com/file/d/([a-zA-Z0-9_-]+)", False),
    (r"[?&]id=([a-zA-Z0-9_-]+)", False),
    (r"^([a-zA-Z0-9_-]{25,})$", False),
)


def drive_link(url) -> Column:
    """(id, is_folder) of a file-sharing link: a folder or file of the host, an id= parameter, or the bare id; id is null if there is none."""
    found = [F.nullif(F.regexp_extract(F.trim(col(url)), p, 1), F.lit("")) for p, _ in DRIVE_LINKS]
    folder = F.lit(False)
    for hit, (_, is_folder) in reversed(list(zip(found, DRIVE_LINKS, strict=True))):
        folder = F.when(hit.isNotNull(), F.lit(is_folder)).otherwise(folder)
    return F.struct(F.coalesce(*found).alias("id"), folder.alias("is_folder"))


def drive_id(url) -> Column:
    return drive_link(url)["id"]


def direct_download(url) -> Column:
    return F.regexp_replace(col(url), r"([?&])dl=0", "$1dl=1")


def dataset_slug(url) -> Column:
    return F.nullif(F.regexp_extract(col(url), r"(?:datasets/)?([A-Za-z0-9_-]+/[A-Za-z0-9_.-]+?)/?(?:\?.*)?$", 1), F.lit(""))


def html_escape(text) -> Column:
    """Text for HTML: the five signs that mark-up or attributes read."""
    out = col(text)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def label(language, **texts: str) -> Column:
    """The text of a language; the first one given where there is none for it."""
    out = F.lit(next(iter(texts.values())))
    for code, text in texts.items():
        out = F.when(col(language) == code, F.lit(text)).otherwise(out)
    return out


def truth_flag(text) -> Column:
    return F.lower(F.trim(col(text))) == "true"


def size_kb(n_bytes) -> Column:
    return F.coalesce(F.bround(col(n_bytes) / F.lit(1024.0), 1), F.lit(0.0))


def aspect_gap(width_a, height_a, width_b, height_b) -> Column:
    a, b = col(width_a) / col(height_a), col(width_b) / col(height_b)
    return F.abs(a - b) / F.greatest(a, b)


def aspect_ok(width_a, height_a, width_b, height_b, tolerance: float = 0.15) -> Column:
    return aspect_gap(width_a, height_a, width_b, height_b) <= tolerance
