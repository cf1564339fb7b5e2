"""Team colours from samples, and the boundaries to models: pandas functions over arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.colour import rgb_to_hex
from touchline.sources.tables import staged

SEED = 7
#: Steps in which cluster centres move; kits are far apart, so they rest after two or three.
STEPS = 10


def far_apart(a: str, b: str) -> Column:
    """Squared distance of two colours, given as prefixes of columns b, g, r."""
    return sum((F.col(f"{a}{k}") - F.col(f"{b}{k}")) * (F.col(f"{a}{k}") - F.col(f"{b}{k}")) for k in "bgr")


def kit_clusters(samples: DataFrame, steps: int = STEPS) -> DataFrame:
    """Two centres of every match's samples by exact 2-means, all matches at once: match_id, n, colours, and b0, g0, r0, b1, g1, r1.

    samples: match_id, b, g, r. The first centre starts at the colour farthest from the mean, the second at the one farthest
    from the first, of equal ones the lesser. Then, ``steps`` times, a colour goes to the nearer centre (the first, if both
    are) and a centre to the mean of its colours, each step being one grouped sum over the distinct colours, so that no
    task needs all samples of a match. A centre without colours stays.
    """
    colours = staged(samples.groupBy("match_id", "b", "g", "r").agg(F.count("*").alias("n")))
    total = lambda k, of=None: F.sum(F.col(k) * F.col("n") if of is None else F.when(of, F.col(k) * F.col("n")))
    heart = colours.groupBy("match_id").agg(F.sum("n").alias("n_samples"), F.count("*").alias("colours"), *[(total(k) / F.sum("n")).alias(f"m{k}") for k in "bgr"])

    held = lambda columns: [F.min(c).alias(c) for c in columns]  # noqa: E731  the same in all rows of a match

    def farthest(centers: DataFrame, origin: str, name: str) -> DataFrame:
        away = colours.join(centers, "match_id").withColumn("far", far_apart("", origin))
        best = F.max(F.struct("far", *[(-F.col(k)).alias(k) for k in "bgr"]))
        found = away.groupBy("match_id").agg(best.alias("best"), *held([c for c in centers.columns if c != "match_id"]))
        return found.withColumns({f"{name}{k}": -F.col(f"best.{k}") for k in "bgr"}).drop("best")

    centers = farthest(farthest(heart, "m", "s"), "s", "t")
    names = [f"{k}{c}" for c in "01" for k in "bgr"]
    centers = centers.select("match_id", "n_samples", "colours", *[F.col(f"{'st'[int(n[1])]}{n[0]}").alias(n) for n in names])
    for _ in range(steps):
        near = colours.join(centers, "match_id")
        gap = [sum((F.col(k) - F.col(f"{k}{c}")) * (F.col(k) - F.col(f"{k}{c}")) for k in "bgr") for c in "01"]
        near = near.withColumn("second", gap[1] < gap[0])
        means = []
        for name in names:
            own = F.col("second") == (name[1] == "1")
            means.append(F.coalesce(total(name[0], own) / F.sum(F.when(own, F.col("n"))), F.min(name)).alias(name))
        centers = near.groupBy("match_id").agg(*held(["n_samples", "colours"]), *means)
    return centers


def calibrate_teams(samples: DataFrame, least: int = 2, steps: int = STEPS) -> DataFrame:
    """Two kit colours of every match, and the sample nearest each, the larger of equal ones, then that of the lesser id.

    samples: match_id, sample_id, b, g, r, area. A row for each cluster: match_id, cluster_id, color, label, sample_id, members,
    sample_image and reason, which is null. Clusters are numbered by their centre's red, then green, then blue. A match
    with fewer than ``least`` samples, or one colour only, has one row that holds nothing but the reason. Samples without a
    colour or match are left out.
    """
    samples = samples.where("match_id is not null and b is not null and g is not null and r is not null").withColumns({k: F.col(k).cast("double") for k in "bgr"})
    centers = staged(kit_clusters(samples, steps))
    swap = F.struct("r1", "g1", "b1") < F.struct("r0", "g0", "b0")
    good = (F.col("n_samples") >= least) & (F.col("colours") >= 2)
    first = lambda k, c: F.greatest(F.lit(0), F.least(F.lit(255), F.when(swap, F.col(f"{k}{'10'[c]}")).otherwise(F.col(f"{k}{c}"))))
    known = centers.where(good).select("match_id", "b0", "g0", "r0", "b1", "g1", "r1", swap.alias("swap"), *[first(k, c).alias(f"c{k}{c}") for c in (0, 1) for k in "bgr"])
    near = samples.join(known, "match_id")
    gap = [sum((F.col(k) - F.col(f"{k}{c}")) * (F.col(k) - F.col(f"{k}{c}")) for k in "bgr") for c in "01"]
    near = near.withColumn("cluster_id", F.when((gap[1] < gap[0]) != F.col("swap"), 1).otherwise(0))
    near = near.select("match_id", "cluster_id", "sample_id", "area", *[F.when(F.col("cluster_id") == 1, F.col(f"c{k}1")).otherwise(F.col(f"c{k}0")).alias(f"c{k}") for k in "bgr"], F.least(*gap).alias("far"))
    best = near.groupBy("match_id", "cluster_id", "cb", "cg", "cr").agg(F.min(F.struct("far", (-F.col("area")).alias("a"), "sample_id")).alias("m"), F.count("*").alias("members"))
    number = (F.col("cluster_id") + 1).cast("string")
    told = best.select(
        "match_id", "cluster_id", rgb_to_hex(F.col("cr"), F.col("cg"), F.col("cb")).alias("color"), F.concat(F.lit("Team "), number).alias("label"),
        F.col("m.sample_id").alias("sample_id"), "members", F.concat(F.lit("team_"), number, F.lit(".jpg")).alias("sample_image"), F.lit(None).cast("string").alias("reason"),
    )
    reason = F.when(F.col("n_samples") < least, "too few samples").otherwise("one colour only")
    return told.unionByName(centers.where(~good).select("match_id", reason.alias("reason")), allowMissingColumns=True)


def candidates_json(clusters: DataFrame) -> DataFrame:
    """match_id, team_candidates (as JSON, null if there are none) and error: what the job of a match tells the user."""
    entry = F.struct("cluster_id", "color", "label", "sample_image")
    listed = clusters.groupBy("match_id").agg(F.array_sort(F.collect_list(F.when(F.col("reason").isNull(), entry))).alias("c"), F.max("reason").alias("error"))
    return listed.select("match_id", F.when(F.size("c") > 0, F.to_json("c")).alias("team_candidates"), "error")


def two_means(pixels: np.ndarray, seed: int = SEED, steps: int = 20) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    centers = pixels[rng.choice(len(pixels), 2, replace=False)].astype(float)
    for _ in range(steps):
        label = ((pixels[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([pixels[label == k].mean(axis=0) if (label == k).any() else centers[k] for k in (0, 1)])
        if np.allclose(new, centers):
            break
        centers = new
    return centers, label


def kit_colour(image: Column, height: Column, width: Column) -> Column:
    """BGR of the shirt in crops given as bytes (rows of 3-byte pixels): of two clusters, the one not in the corners."""

    @F.pandas_udf("struct<b:double,g:double,r:double>")
    def colour(image: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
        out = []
        for data, h, w in zip(image, height, width, strict=True):
            pixels = np.frombuffer(data, dtype=np.uint8).reshape(int(h), int(w), 3)
            centers, label = two_means(pixels.reshape(-1, 3))
            label = label.reshape(int(h), int(w))
            corners = [label[0, 0], label[0, -1], label[-1, 0], label[-1, -1]]
            out.append(centers[1 - max(set(corners), key=corners.count)])
        return pd.DataFrame(out, columns=["b", "g", "r"])

    return colour(image, height, width)


def sharpness(image: Column, height: Column, width: Column) -> Column:
    """Variance of the Laplacian of grey crops given as bytes."""

    @F.pandas_udf("double")
    def variance(image: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        out = []
        for data, h, w in zip(image, height, width, strict=True):
            g = np.pad(np.frombuffer(data, dtype=np.uint8).reshape(int(h), int(w)).astype(float), 1, mode="reflect")
            out.append((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())
        return pd.Series(out, dtype="float64")

    return variance(image, height, width)


def save_weights(spark: SparkSession, weights: dict[str, np.ndarray], path: str) -> None:
    """A row an array: name, shape, values."""
    rows = [(k, list(w.shape), [float(x) for x in w.ravel()]) for k, w in weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}


def event_scores(sequence: Column, weights: dict[str, np.ndarray], separate: bool = False) -> Column:
    """Class probabilities of feature windows under a recurrent network (input, forget, cell, output gates).

    They sum to 1, or with ``separate`` each class has its own.
    """
    hidden = weights["wh"].shape[0]

    @F.pandas_udf("array<double>")
    def scores(windows: pd.Series) -> pd.Series:
        if not len(windows):
            return pd.Series([], dtype="object")
        x = np.stack([np.stack(w) for w in windows]).astype(float)
        h = c = np.zeros((len(x), hidden))
        for t in range(x.shape[1]):
            gates = x[:, t] @ weights["wx"] + h @ weights["wh"] + weights["b"]
            i, f, g, o = (gates[:, k * hidden : (k + 1) * hidden] for k in range(4))
            sig = lambda v: 1 / (1 + np.exp(-v))
            c = sig(f) * c + sig(i) * np.tanh(g)
            h = sig(o) * np.tanh(c)
        z = h @ weights["wo"] + weights["bo"]
        if separate:
            return pd.Series(list(1 / (1 + np.exp(-z))))
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return pd.Series(list(e / e.sum(axis=1, keepdims=True)))

    return scores(sequence)
