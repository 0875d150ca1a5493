"""Queries that make small pictures from table keys and run the image functions over them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as c
from tessera.plans.registry import query
from tessera.runtime import python_workers, table

PIXELS = "SELECT s_suppkey AS s, x, y, (s_suppkey * 31 + x * 57 + y * 91 + x * y * 13) % 256 AS r, (s_suppkey * 17 + x * 29 + y * 71) % 256 AS g, (s_suppkey * 7 + x * 11 + y * 3) % 256 AS b FROM supplier, range({w}) AS i(x), range({h}) AS j(y)"
GRAY = "SELECT s, x, y, (r * 19595 + g * 38470 + b * 7471 + 32768) >> 16 AS v FROM px"
HEX = "lower(lpad(to_hex((string_agg(bit::VARCHAR, '' ORDER BY k))::BIT::BIGINT), 16, '0'))"


def _keys(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("s"))


def _pixels(s: int, w: int, h: int):
    """The picture of PIXELS."""
    import numpy as np

    x, y = np.meshgrid(np.arange(w), np.arange(h))
    return np.stack([(s * 31 + x * 57 + y * 91 + x * y * 13) % 256, (s * 17 + x * 29 + y * 71) % 256, (s * 7 + x * 11 + y * 3) % 256], axis=-1).astype(np.uint8)


def _hash(spark, d, name: str, w: int, h: int) -> DataFrame:
    python_workers(spark)

    @F.pandas_udf("long")
    def signature(s: pd.Series) -> pd.Series:
        from tessera.functions import images
        from tessera.plans.pictures import _pixels

        return pd.Series([getattr(images, name)(_pixels(int(k), w, h)) for k in s], dtype="int64")

    return _keys(spark, d).select("s", c.to_hex(signature("s")).alias("hash"))


@query(f"""WITH px AS ({PIXELS.format(w=9, h=8)}), gray AS ({GRAY}),
bits AS (SELECT a.s, a.y * 8 + a.x AS k, (b.v > a.v)::INT AS bit FROM gray a JOIN gray b ON b.s = a.s AND b.y = a.y AND b.x = a.x + 1) SELECT s, {HEX} AS hash FROM bits GROUP BY s""")
def image_dhash(spark, d):
    return _hash(spark, d, "dhash", 9, 8)


@query(f"""WITH px AS ({PIXELS.format(w=32, h=32)}), gray AS ({GRAY}), basis AS (SELECT k, n, 2 * cos(pi() * k * (2 * n + 1) / 64) AS w FROM range(8) AS i(k), range(32) AS j(n)),
across AS (SELECT s, y, k AS l, sum(v * w) AS v FROM gray JOIN basis ON n = x GROUP BY ALL), low AS (SELECT s, k * 8 + l AS k, sum(v * w) AS v FROM across JOIN basis ON n = y GROUP BY ALL),
bits AS (SELECT s, k, (v > median(v) OVER (PARTITION BY s))::INT AS bit FROM low) SELECT s, {HEX} AS hash FROM bits GROUP BY s""")
def image_phash(spark, d):
    return _hash(spark, d, "phash", 32, 32)


@query("""WITH b AS (SELECT s_suppkey AS s, 64 + s_suppkey % 30 AS w, 50 + s_suppkey % 20 AS h, 3 + s_suppkey % 9 AS x0, 2 + s_suppkey % 7 AS y0, 10 + s_suppkey % 40 AS bw, 12 + s_suppkey % 30 AS bh FROM supplier),
p AS (SELECT *, greatest(2, floor(w * 0.04)::BIGINT) AS px, greatest(2, floor(h * 0.04)::BIGINT) AS py, bw >= 16 AND bh >= 16 AS cut FROM b)
SELECT s::BIGINT AS s, (CASE WHEN cut THEN greatest(0, x0 - px) ELSE 0 END)::INT AS left_, (CASE WHEN cut THEN greatest(0, y0 - py) ELSE 0 END)::INT AS top, (CASE WHEN cut THEN least(w, x0 + bw + px) ELSE w END)::INT AS right_, (CASE WHEN cut THEN least(h, y0 + bh + py) ELSE h END)::INT AS bottom FROM p""")
def image_trim(spark, d):
    python_workers(spark)

    @F.pandas_udf("left_ int, top int, right_ int, bottom int")
    def box(s: pd.Series) -> pd.DataFrame:
        import numpy as np

        from tessera.functions import images

        out = []
        for k in s:
            x = np.full((50 + k % 20, 64 + k % 30, 3), 250, np.uint8)
            x[2 + k % 7 : 14 + k % 7 + k % 30, 3 + k % 9 : 13 + k % 9 + k % 40] = (40, 90, 160)
            out.append(images.trim_border(x))
        return pd.DataFrame(out, columns=["left_", "top", "right_", "bottom"])

    return _keys(spark, d).select("s", box("s").alias("b")).select("s", "b.*")


def _lab(r: str, g: str, b: str) -> str:
    """SQL for [L, a, b] of three columns."""
    line = lambda v: f"(CASE WHEN {v} / 255.0::DOUBLE > 0.04045 THEN pow(({v} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE {v} / 255.0::DOUBLE / 12.92 END)"
    xyz = [f"(({line(r)} * {p} + {line(g)} * {q} + {line(b)} * {s}) / {w})" for p, q, s, w in ((0.4124564, 0.3575761, 0.1804375, 0.95047), (0.2126729, 0.7151522, 0.0721750, 1.0), (0.0193339, 0.1191920, 0.9503041, 1.08883))]
    f = [f"(CASE WHEN {v} > 0.008856 THEN cbrt({v}) ELSE 7.787 * {v} + 16.0::DOUBLE / 116 END)" for v in xyz]
    return f"[116 * {f[1]} - 16, 500 * ({f[0]} - {f[1]}), 200 * ({f[1]} - {f[2]})]"


#: Three flat colours of a picture of 20 columns, in 4, 6 and 10 columns; the first one's pixels are see-through for even keys.
FLAT = f"""col AS (SELECT s_suppkey AS s, k, (s_suppkey * (31 + k * 40) + k * 83) % 256 AS r, (s_suppkey * (17 + k * 22) + k * 51) % 256 AS g, (s_suppkey * (7 + k * 9) + k * 120) % 256 AS b, [4, 6, 10][k + 1] AS n FROM supplier, range(3) AS i(k)),
seen AS (SELECT * FROM col WHERE k > 0 OR s % 2 = 1), same AS (SELECT s, r, g, b, sum(n) AS n FROM seen GROUP BY ALL), pal AS (SELECT s, {_lab("r", "g", "b")} AS lab, n / sum(n) OVER (PARTITION BY s) AS share FROM same)"""


def _palettes(spark, d) -> DataFrame:
    """s and palette (array of L, a, b, share) of the pictures of FLAT."""
    python_workers(spark)

    @F.pandas_udf("array<array<double>>")
    def palette(s: pd.Series) -> pd.Series:
        import numpy as np

        from tessera.functions import images

        out = []
        for k in s:
            x, alpha, at = np.zeros((10, 20, 3), np.uint8), np.full((10, 20), 255, np.uint8), 0
            for i, n in enumerate((4, 6, 10)):
                x[:, at : at + n] = ((k * (31 + i * 40) + i * 83) % 256, (k * (17 + i * 22) + i * 51) % 256, (k * (7 + i * 9) + i * 120) % 256)
                at += n
            if k % 2 == 0:
                alpha[:, :4] = 128
            out.append([list(p) for p in images.palette(x, alpha)])
        return pd.Series(out)

    return _keys(spark, d).select("s", palette("s").alias("palette"))


@query(f"""WITH {FLAT} SELECT s::BIGINT AS s, (row_number() OVER (PARTITION BY s ORDER BY share DESC, lab[1], lab[2], lab[3]) - 1)::INT AS rank, round(lab[1], 3)::DOUBLE + 0.0 AS l, round(lab[2], 3)::DOUBLE + 0.0 AS a, round(lab[3], 3)::DOUBLE + 0.0 AS b, round(share, 6)::DOUBLE AS share FROM pal""")
def image_palette(spark, d):
    """Palettes of pictures with fewer colours than clusters, whose see-through pixels don't count."""
    rows = _palettes(spark, d).select("s", F.posexplode("palette").alias("rank", "p"))
    return rows.select("s", "rank", *[(F.round(F.get("p", F.lit(i)), 3) + 0.0).alias(n) for i, n in enumerate("lab")], F.round(F.get("p", F.lit(3)), 6).alias("share"))


@query(f"""WITH {FLAT}, one AS (SELECT s, arg_max(lab, (share, -lab[1])) AS p FROM pal GROUP BY 1), two AS (SELECT s, {_lab("r", "g", "b")} AS p, k, [0.3, 0.7][k] AS w FROM col WHERE k > 0),
cost AS (SELECT s, k, w, sqrt(pow(one.p[1] - two.p[1], 2) + pow(one.p[2] - two.p[2], 2) + pow(one.p[3] - two.p[3], 2)) AS e FROM one JOIN two USING (s)),
both_ AS (SELECT x.s, x.e AS e1, x.w AS w1, y.e AS e2, y.w AS w2 FROM cost x JOIN cost y USING (s) WHERE x.k = 1 AND y.k = 2),
m AS (SELECT s, CASE WHEN e1 <= e2 THEN ((1 + w1) / 2 * e1 + w2 / 2 * 200) / ((1 + w1) / 2 + w2 / 2) ELSE ((1 + w2) / 2 * e2 + w1 / 2 * 200) / ((1 + w2) / 2 + w1 / 2) END AS matched, w1 * e1 + w2 * e2 AS moved FROM both_)
SELECT s::BIGINT AS s, round(greatest(matched, moved), 4)::DOUBLE AS distance, greatest(matched, moved) <= 80 AS passed FROM m""")
def palette_gate(spark, d):
    """One colour against two: the gate's verdict and distance."""
    python_workers(spark)
    r, g, b = ([F.col("s") * (p + k * q) % 256 for k in range(3)] for p, q in ((31, 40), (17, 22), (7, 9)))
    channel = lambda x, step: [(v + k * step) % 256 for k, v in enumerate(x)]
    red, green, blue = channel(r, 83), channel(g, 51), channel(b, 120)
    second = [F.array(*c.rgb_to_lab(red[k], green[k], blue[k]), F.lit(w)) for k, w in ((1, 0.3), (2, 0.7))]
    first = F.get("palette", F.lit(0))
    rows = _palettes(spark, d).select("s", F.array(F.concat(F.slice(first, 1, 3), F.array(F.lit(1.0)))).alias("x"), F.array(*second).alias("y"))

    @F.pandas_udf("passed boolean, distance double, reason string")
    def gate(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        from tessera.functions import images

        return pd.DataFrame([images.verify_colour(list(p), list(q), 0.0, 80.0) for p, q in zip(x, y, strict=True)], columns=["passed", "distance", "reason"])

    return rows.select("s", gate("x", "y").alias("v")).select("s", F.round("v.distance", 4).alias("distance"), "v.passed")


@query(f"""WITH c AS (SELECT p_partkey, {_lab("(p_partkey * 37) % 256", "(p_partkey * 101) % 256", "(p_partkey * 211) % 256")} AS p, {_lab("(p_partkey * 53) % 256", "(p_partkey * 29) % 256", "(p_partkey * 7) % 256")} AS q FROM part)
SELECT p_partkey, round(sqrt(pow(p[1] - q[1], 2) + pow(p[2] - q[2], 2) + pow(p[3] - q[3], 2)), 3)::DOUBLE AS delta_e FROM c""")
def delta_e(spark, d):
    k = lambda n: F.col("p_partkey") * n % 256
    rows = table(spark, d, "part").select("p_partkey", F.array(*c.rgb_to_lab(k(37), k(101), k(211))).alias("p"), F.array(*c.rgb_to_lab(k(53), k(29), k(7))).alias("q"))
    at = lambda n: [F.get(n, F.lit(i)) for i in range(3)]
    return rows.select("p_partkey", F.round(c.delta_e(at("p"), at("q")), 3).alias("delta_e"))


@query("""WITH i AS (SELECT s_suppkey AS s, CASE s_suppkey % 4 WHEN 0 THEN 'invalid' WHEN 1 THEN 'too large' ELSE 'valid' END AS status, 10 + s_suppkey % 50 AS w, 12 + s_suppkey % 30 AS h FROM supplier)
SELECT s::BIGINT AS s, (CASE status WHEN 'valid' THEN w WHEN 'too large' THEN 60000 END)::INT AS width, (CASE status WHEN 'valid' THEN h WHEN 'too large' THEN 50000 END)::INT AS height, status FROM i""")
def header_status(spark, d):
    """Sizes and status from headers: pictures, pictures that claim three billion pixels, and files that are none."""
    from tessera.sources.files import header_status as status

    python_workers(spark)

    @F.pandas_udf("binary")
    def content(s: pd.Series) -> pd.Series:
        import struct

        import numpy as np

        from tessera.functions.mutations import encode_png

        out = []
        for k in s:
            raw = bytearray(encode_png(np.full((12 + k % 30, 10 + k % 50, 3), k % 256, np.uint8)))
            if k % 4 == 1:
                raw[16:24] = struct.pack(">II", 60_000, 50_000)
            out.append(b"no image %d" % k if k % 4 == 0 else bytes(raw))
        return pd.Series(out)

    return status(_keys(spark, d).withColumn("content", content("s")), 89_478_485).select("s", "width", "height", "status")
