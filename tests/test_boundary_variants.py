import numpy as np
from pyspark.sql import functions as F

from touchline.operators import boundary, identity


def test_crop_variants_by_plain_loops(spark):
    rng = np.random.default_rng(1)
    crops = [(k, rng.integers(0, 256, (h, w), dtype=np.uint8), h, w) for k, (h, w) in enumerate([(8, 8), (3, 5), (1, 1), (2, 9), (40, 30)])]
    rows = [(k, g.tobytes(), h, w) for k, g, h, w in crops] + [(10, b"", 1, 1), (11, b"abc", 2, 2), (12, None, 1, 1), (13, b"a", None, 1)]
    got = {(r.frame_num, r.variant): np.frombuffer(bytes(r.image), dtype=np.uint8) for r in boundary.crop_variants(spark.createDataFrame(rows, "frame_num long, image binary, height int, width int")).collect()}
    assert got.keys() == {(k, v) for k, *_ in crops for v in (0, 1)}
    for k, grey, h, w in crops:
        assert got[k, 0].tolist() == grey.ravel().tolist()
        limit = max(1, int(2.0 * h * w / 256))
        counts = [int((grey == v).sum()) for v in range(256)]
        spare = sum(max(c - limit, 0) for c in counts)
        even = [[int(np.floor((sum(min(c, limit) for c in counts[: v + 1]) + (v + 1) * spare / 256) * 255 / (h * w) + 0.5)) for v in line] for line in grey.tolist()]
        edge = lambda i, n: 0 if n == 1 else n - 1 - abs(n - 1 - abs(i))
        for y in range(h):
            for x in range(w):
                reflect = (lambda i, n: min(max(i, 0), n - 1)) if min(h, w) == 1 else edge
                blur = sum((2 - abs(a)) * (2 - abs(b)) * even[reflect(y + a, h)][reflect(x + b, w)] for a in (-1, 0, 1) for b in (-1, 0, 1)) / 16
                assert got[k, 1][y * w + x] == min(255, max(0, int(np.floor(1.8 * even[y][x] - 0.8 * blur + 0.5 + 1e-9)))), (k, y, x)


def test_variants_double_the_weight_not_the_support(spark):
    crops = spark.createDataFrame([(0, 7, f, 0.9, bytes([60] * 4), 2, 2) for f in (1, 2)], "match_id long, track_id long, frame_num long, quality double, image binary, height int, width int")

    def reader():
        return lambda image: [("7", 0.8)]

    one, two = boundary.read_crops(crops, reader), boundary.read_crops(boundary.crop_variants(crops), reader)
    a, b = (identity.consensus(identity.readings(r, "number")).first() for r in (one, two))
    assert two.count() == 2 * one.count() and a.support == b.support == 2 and a.value == b.value == 7
    weight = lambda r: r.agg(F.sum(F.col("confidence") * F.col("crop_quality")).alias("w")).first().w
    assert abs(weight(two) - 2 * weight(one)) < 1e-9
