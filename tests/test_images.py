from __future__ import annotations

import itertools
import struct
import zlib

import numpy as np
import pytest

from tessera.config import make_config
from tessera.engine import run
from tessera.functions import mutations
from tessera.functions.embedding import Embedder, each_image
from tessera.functions import images as im


def png(pixels: np.ndarray) -> bytes:
    h, w, n = pixels.shape
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if n == 3 else 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def chair(colour, size=128):
    x = np.full((size, size, 3), 255, np.uint8)
    x[30:70, 40:90] = colour
    x[70:110, 40:50] = colour
    x[70:110, 80:90] = colour
    x[20:30, 60:66] = (240, 200, 20)
    return x


def test_header_size():
    assert im.header_size(png(chair((1, 2, 3)))) == (128, 128)
    assert im.header_size(b"GIF89a" + struct.pack("<HH", 7, 9)) == (7, 9)
    assert im.header_size(b"not an image") is None and im.header_size(b"") is None


def test_hashes_are_stable_and_tell_apart():
    a, rng = chair((20, 45, 130)), np.random.default_rng(1)
    b = rng.integers(0, 255, (128, 128, 3), dtype=np.uint8)
    assert im.phash(a) == im.phash(a.copy())
    assert bin((im.phash(a) ^ im.phash(b)) & (2**64 - 1)).count("1") > 10
    small = im.resize(a, 96, 96)
    assert bin((im.dhash(a) ^ im.dhash(small)) & (2**64 - 1)).count("1") <= 6
    assert im.four_hashes(a[:20])[2:] == (None, None)


def test_lab():
    white = im.lab(np.array([[[255, 255, 255]]], np.uint8))[0, 0]
    assert white[0] == pytest.approx(100, abs=0.01) and abs(white[1:]).max() < 0.02


def test_trim_finds_the_content():
    # 4 % of the whole sides as margin
    assert im.trim_border(chair((20, 45, 130))) == (35, 15, 95, 115)
    x = np.full((400, 400, 3), 255, np.uint8)
    x[180:220, 180:220] = 0
    assert im.trim_border(x) == (164, 164, 236, 236)
    assert im.trim_border(np.random.default_rng(0).integers(0, 255, (64, 64, 3), dtype=np.uint8)) == (0, 0, 64, 64)


def test_palette_distances():
    p = [(50.0, 10.0, -20.0, 1.0)]
    assert im.palette_distance(p, p) == 0
    assert im.palette_distance(p, [(50.0, 60.0, 30.0, 1.0)]) > 10
    assert im.palette_distance(p, [(52.0, 11.0, -19.0, 1.0)]) < 5


def test_transport_against_matching():
    rng = np.random.default_rng(3)
    cost = rng.random((4, 4))
    best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(4))) / 4
    assert im._transport(cost, np.full(4, 0.25), np.full(4, 0.25)) == pytest.approx(best)


def test_assignment_against_all_orders():
    rng = np.random.default_rng(5)
    for _ in range(100):
        n = int(rng.integers(1, 7))
        cost = rng.integers(0, 12, (n, n)).astype(float)
        got = im.assignment(cost)
        assert sorted(got) == list(range(n)) and sum(cost[i, j] for i, j in enumerate(got)) == min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(n)))
    many = [(float(i), 0.0, 0.0, 0.05) for i in range(20)]
    assert im.palette_distance(many, many[::-1]) < 1e-9


def score(a, b):
    return im.recolour_score(im.cell_grids(a), im.cell_grids(b))


def test_recolour():
    room = np.full((160, 160, 3), (225, 218, 208), np.uint8)
    room[95:] = (190, 172, 148)
    a, b = room.copy(), room.copy()
    a[60:130, 35:125], b[60:130, 35:125] = (210, 145, 30), (25, 45, 110)
    assert score(a, b) > 25 and score(a, a) == 0
    assert im.recolour_score(im.cell_grids(a[:20]), im.cell_grids(b)) == 0


def test_recolour_allows_another_angle():
    a, b = np.full((160, 160, 3), (235, 228, 218), np.uint8), np.full((160, 160, 3), (200, 192, 182), np.uint8)
    a[:, 95:], b[:, :55] = (140, 135, 128), (150, 140, 130)
    a[75:145, 55:145] = b[75:145, 15:105] = (210, 145, 30)
    assert score(a, b) == 0


def test_recolour_needs_a_scene_that_lines_up_before_light_is_allowed_for():
    room = np.full((160, 160, 3), 200, np.uint8)
    a, b = room.copy(), (room * 0.6).astype(np.uint8)
    a[60:130, 35:125], b[60:130, 35:125] = (220, 180, 40), (20, 30, 110)
    assert score(a, b) == 0


def test_recompression():
    rng = np.random.default_rng(1)
    x = mutations._bytes(im.resize(rng.integers(0, 255, (8, 8, 3), dtype=np.uint8), 61, 45))
    fine, coarse = (np.abs(mutations.recompress(x, q).astype(int) - x).mean() for q in (95, 20))
    assert fine < 3 < coarse < 30 and mutations.recompress(x, 70).shape == x.shape
    a = chair((20, 45, 130))
    assert bin((im.phash(a) ^ im.phash(mutations.recompress(a, 70))) & (2**64 - 1)).count("1") <= 8


def test_embedder_loads_once_and_takes_batches():
    loads, sizes = [], []

    def load():
        loads.append(1)
        return lambda images: sizes.append(len(images)) or np.array([[x.mean(), 1.0, 0.0] for x in images])

    e = Embedder(load, batch=4)
    v = e.vectors([np.full((4, 4, 3), i, np.uint8) for i in range(10)])
    assert v.shape == (10, 3) and np.allclose(np.linalg.norm(v, axis=1), 1) and sizes == [4, 4, 2] and e.dimension == 3 and len(loads) == 1
    assert len(e.vectors([])) == 0


def test_config_collects_errors():
    with pytest.raises(ValueError) as e:
        make_config({"phash_threshold": 99, "color_space": "rgb", "no_such": 1})
    assert "phash_threshold" in str(e.value) and "color_space" in str(e.value)
    assert make_config({"log_level": "info"}).log_level == "INFO"


CONFIG = {"similarity_threshold": 0.85, "similarity_k": 5, "color_n_clusters": 3, "color_min_pixel_count": 50, "use_background_removal": False}


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "images"
    at.mkdir()
    (at / "a.png").write_bytes(png(chair((20, 45, 130))))
    (at / "b.PNG").write_bytes(png(chair((20, 45, 130))))
    (at / "c.png").write_bytes(png(chair((185, 30, 35))))
    (at / "bad.png").write_bytes(b"no image")
    (at / "cut.png").write_bytes(png(chair((1, 2, 3)))[:60])
    bomb = bytearray(png(chair((9, 9, 9))))
    bomb[16:24] = struct.pack(">II", 60_000, 60_000)
    (at / "bomb.png").write_bytes(bytes(bomb))
    return at


def test_run(spark, folder, tmp_path):
    result = run(spark, str(folder), make_config(CONFIG), each_image(lambda rgb: [1.0, 0.0]), output=str(tmp_path / "out" / "report"))
    assert [[m.rsplit("/", 1)[1] for m in r.members] for r in result.groups.collect()] == [["a.png", "b.PNG"]]
    assert {r.status for r in result.inventory.collect()} == {"CANONICAL_MASTER", "DUPLICATE", "UNIQUE"}
    t = result.telemetry.first()
    assert (t.total_images, t.skipped_images, t.stage1_exact_groups, t.stage1_exact_images, t.stage4_rejected) == (3, 3, 1, 2, 1)
    # rejected by the hash stage, and given the similarity that the search found
    assert [(r.stage, r.similarity) for r in t.rejected_pairs] == [("hash", 1.0)] and t.rejected_pairs[0].phash_distance is not None
    assert {r.path.rsplit("/", 1)[1]: r.status for r in result.skipped.collect()} == {"bad.png": "invalid", "cut.png": "invalid", "bomb.png": "too large"}
    assert len(result.written) == 7 and all((tmp_path / "out" / w.rsplit("/", 1)[1]).exists() for w in result.written)


def test_run_resumes_and_samples(spark, folder, tmp_path):
    seen = str(tmp_path / "seen")

    def background(rgb):
        with open(seen, "a") as file:
            file.write("x")
        return np.full(rgb.shape[:2], 255, np.uint8)

    config = make_config({**CONFIG, "use_background_removal": True})
    go = lambda **more: run(spark, str(folder), config, background=background, cache=str(tmp_path / "cache"), **more)
    assert go(sample=2).telemetry.first().total_images == 2
    one = len(open(seen).read())
    first = go(resume=True)
    assert first.telemetry.first().cached_images == 1
    two = len(open(seen).read())
    again = go(resume=True)
    assert again.telemetry.first().cached_images == 2 and len(open(seen).read()) == two > one >= 1
    assert [r.members for r in again.groups.collect()] == [r.members for r in first.groups.collect()] != []


def test_run_on_nothing(spark, tmp_path):
    (tmp_path / "bad.png").write_bytes(b"no image")
    result = run(spark, str(tmp_path), make_config(CONFIG))
    assert result.groups.count() == 0 and result.telemetry.first().total_images == 0 and result.skipped.count() == 1


def test_registered_functions(spark):
    from tessera.functions.register import register_functions

    assert len(register_functions(spark)) == 6
    row = spark.sql("SELECT hamming(7, 1) AS h, hash_hex(-1) AS x, confidence_band(75) AS b, model_stem('Sofa_View2 ') AS s, model_stem('Sofa (2)') AS t, lab(255, 255, 255).l AS l").first()
    assert (row.h, row.x, row.b, row.t) == (2, "f" * 16, "medium", "sofa") and abs(row.l - 100) < 0.01
    assert spark.sql("SELECT palette_distance(array(array(50D, 10D, 0D, 1D)), array(array(50D, 10D, 3D, 1D))) AS d").first().d == pytest.approx(3)


def test_command_line(spark, folder, tmp_path, capsys):
    from tessera.__main__ import main

    (tmp_path / "c.yaml").write_text("color:\n  use_background_removal: false\n  color_min_pixel_count: 50\n")
    assert main([str(folder), "--output", str(tmp_path / "r"), "--config", str(tmp_path / "c.yaml"), "--sample", "2"]) == 0
    assert "r_telemetry.json" in capsys.readouterr().out and (tmp_path / "r.csv").exists()
    with pytest.raises(SystemExit):
        main([str(folder), "--output", "x", "--resume"])
