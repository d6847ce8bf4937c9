import io
import wave

import numpy as np

from pyspark.sql import functions as F

from veilspan.llm import chroma as C


def melody(seed, notes=60):
    draw = np.random.default_rng(seed)
    return np.frombuffer(C.render(draw.normal(0, 1, notes).tolist()), "<i2")


def test_integral_image_filters_by_hand():
    draw = np.random.default_rng(0)
    chroma = np.abs(draw.normal(0, 1, (40, 12)))
    found = C.integers(chroma)
    assert len(found) == 40 - C.WIDTH + 1 and len(set(C.filters())) == C.FILTERS
    for t in (0, 7, len(found) - 1):
        packed = 0
        for shape, c, h, w in C.filters():
            box = chroma[t : t + w, c : c + h]
            a = {
                0: lambda: box.sum(),
                1: lambda: box[:, : h // 2].sum(),
                2: lambda: box[: w // 2].sum(),
                3: lambda: box[: w // 2, : h // 2].sum() + box[w // 2 :, h // 2 :].sum(),
                4: lambda: box[:, h // 3 : h - h // 3].sum(),
                5: lambda: box[w // 3 : w - w // 3].sum(),
            }[shape]()
            b = w * h / 4 if shape == 0 else box.sum() - a
            step = int(np.searchsorted(C.CUTS[shape], np.log((1 + a) / (1 + b)), side="right"))
            packed = packed << 2 | (step ^ step >> 1)
        assert packed == int(found[t])


def test_wav_and_pcm():
    raw = melody(1)
    sink = io.BytesIO()
    with wave.open(sink, "wb") as out:
        out.setparams((2, 2, C.RATE, 0, "NONE", ""))
        out.writeframes(np.repeat(raw, 2).astype("<i2").tobytes())
    assert np.array_equal(C.fingerprint(sink.getvalue()), C.fingerprint(raw.tobytes()))
    assert len(C.fingerprint(None)) == len(C.fingerprint(b"")) == len(C.fingerprint(b"\0" * 100)) == 0
    assert len(C.fingerprint(b"\0" * 40_000)) > 0
    assert len(C.samples(raw.tobytes(), 2 * C.RATE)) == len(raw) // 2


def test_alignment(spark):
    first, second = melody(2), melody(3)
    draw = np.random.default_rng(5)
    noisy = (first + draw.normal(0, 900, len(first))).clip(-32768, 32767)
    late = np.concatenate((np.zeros(C.HOP * 12), first))
    rows = [(100, first), (1, first), (2, second), (3, noisy), (4, late), (5, np.zeros(0)), (6, np.zeros(30_000)), (200, second[C.HOP * 10 :])]
    media = spark.createDataFrame([(i, bytearray(np.asarray(x).astype("<i2").tobytes())) for i, x in rows] + [(7, None)], "id long, media binary")
    found = {r.id: r for r in C.align(C.fingerprints(media, "id", "media"), media.where("id % 100 = 0")).collect()}
    assert len(found) == 9 and found[100].class_id == found[1].class_id == 1 and found[5].class_id == found[7].class_id == 5
    assert found[2].links is None and found[100].links is None and found[100].n_links == found[1].n_links == 2
    links = {x.class_id: x for x in found[1].links}
    assert set(links) == {3, 4} and links[3].offset == 0 and links[4].offset == 12 and links[3].errors < 0.1
    (link,) = found[200].links
    assert link.class_id == 2 and link.offset == 10
    assert C.align(C.fingerprints(media.limit(0), "id", "media"), media.limit(0)).collect() == []


def test_render_odd_vectors():
    assert C.render(None) == C.render([]) == b"" and len(C.render([float("nan"), 1.0, 0.0])) == 3 * 512 * 2


def test_recall_against_brute_force(spark):
    draw = np.random.default_rng(9)
    media, n = [], 40
    for k in range(n):
        sound = np.frombuffer(C.render(draw.normal(0, 1, 64).tolist()), "<i2").astype(float)
        other = np.roll(sound + draw.normal(0, draw.uniform(300, 9000), len(sound)), int(draw.integers(0, 256)))[C.HOP * int(draw.integers(0, 20)) :]
        media += [(100 * k, bytearray(sound.astype("<i2").tobytes())), (100 * k + 1, bytearray(other.clip(-32768, 32767).astype("<i2").tobytes()))]
    rows = spark.createDataFrame(media, "id long, media binary")
    prints = {i: C.fingerprint(bytes(m)) for i, m in media}
    want = set()
    for a in range(0, 100 * n, 100):
        for b, other in prints.items():
            best = min((e / (32 * m), -o) for o in range(-len(other) // 2, len(other) // 2) for e, m in [C.bit_errors(prints[a], other, o)] if m >= C.LEAST_OVERLAP * min(len(prints[a]), len(other)))
            if a != b and best[0] <= C.MAX_ERRORS:
                want.add((a, b))
    found = {(r.id, x.class_id) for r in C.align(C.fingerprints(rows, "id", "media"), rows.where("id % 100 = 0")).collect() for x in r.links or []}
    assert len(want) >= 15 and found <= want and len(found) >= 0.9 * len(want)


def test_recall_up_to_fifteen_percent(spark):
    media, n = [], 60
    for k in range(n):
        draw = np.random.default_rng(k)
        sound = np.frombuffer(C.render(draw.normal(0, 1, 64).tolist()), "<i2").astype(float)
        other = np.roll(sound + draw.normal(0, draw.uniform(6000, 20000), len(sound)), int(draw.integers(0, 256)))[C.HOP * int(draw.integers(0, 50)) :]
        media += [(100 * k, bytearray(sound.astype("<i2").tobytes())), (100 * k + 1, bytearray(other.clip(-32768, 32767).astype("<i2").tobytes()))]
    rows = spark.createDataFrame(media, "id long, media binary")
    prints = {i: C.fingerprint(bytes(m)) for i, m in media}
    want = {}
    for a in range(0, 100 * n, 100):
        for b, other in prints.items():
            tried = ((e / (32 * m), -m, abs(o), o) for o in range(-len(prints[a]), len(other)) for e, m in [C.bit_errors(prints[a], other, o)] if m and m >= C.LEAST_OVERLAP * min(len(prints[a]), len(other)))
            best = min(tried)
            if a != b and best[0] <= 0.15:
                want[a, b] = best[0]
    # Queries in several blocks find the same.
    found = {(r.id, x.class_id): x.errors for r in C.align(C.fingerprints(rows, "id", "media"), rows.where("id % 100 = 0"), query_places=1_000).collect() for x in r.links or []}
    assert C.MAX_ERRORS == 0.15 and sum(e > 0.07 for e in want.values()) >= 15
    assert set(found) == set(want) and all(abs(found[k] - want[k]) < 1e-12 for k in want)


def test_every_place_of_a_query_counts():
    x, y, z = (np.random.default_rng(k).integers(0, 1 << 32, 40, dtype=np.uint32) for k in (1, 2, 3))
    whole, excerpt = np.concatenate((x, y, x, z)), np.concatenate((x, z))
    a, b, offset, errors, overlap = C.QueryIndex([whole]).search([excerpt], 0.15, 0.5)
    assert (a.tolist(), b.tolist(), offset.tolist(), errors.tolist(), overlap.tolist()) == ([0], [0], [-80], [0], [80])


def test_silence_and_awkward_rows(spark):
    """Silent recordings of any length are one class without links to one another; null ids, repeated rows, clashing names."""
    rows = [(i, b"\0" * (2 * C.RATE + 700 * (i % 40))) for i in range(300)] + [(None, b""), (None, None), (300, C.render([0.1, 0.9, -0.4] * 20)), (300, C.render([0.1, 0.9, -0.4] * 20))]
    table = spark.createDataFrame(rows, "id long, media binary").withColumn("Class_ID", F.lit("x")).withColumn("links", F.lit("x"))
    prints = C.fingerprints(table, "id", "media").withColumn("digest", F.lit("x"))
    found = C.align(prints, table.where("id % 100 = 0").unionByName(table.where("id = 300"))).collect()
    assert len(found) == 304 and {r.class_id for r in found if r.id is not None and r.id < 300} == {0}
    assert all(r.n_links in (0, None) and not r.links for r in found) and sum(r.n_integers == 0 for r in found) == 2
    assert [r.class_id for r in found if r.id == 300] == [300, 300]
    assert C.align(prints.limit(0), table).collect() == []
