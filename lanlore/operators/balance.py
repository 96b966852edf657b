"""Splitting and rebalancing of labelled tables.

Every choice of rows depends on a hash of the row's key and a seed (or on an order column
the caller names), so a lost task or another partitioning gives the same sample again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .knn import nearest
from .running import ranked
from .summary import class_balance, imbalance_ratio, per_class

COPIES_PER_TASK_ROW = 4096


def class_counts(df: DataFrame, label: str = "label") -> dict[int, int]:
    """Rows per class; a class table is a handful of rows."""
    return {r[label]: r["n"] for r in class_balance(df, label).select(label, "n").collect()}


def stratified_split(
    df: DataFrame,
    key: str,
    label: str = "label",
    test_fraction: float = 0.2,
    seed: int = 42,
    order: str | None = None,
) -> DataFrame:
    """BAL1: adds `is_test`, true for the first round(n_c * fraction) rows of each class in hash order.

    Rows without a class cannot be stratified and stay in the training part.
    """
    numbered = ranked(df, "_rank", by=[label], order=order, keys=[key], seed=seed)
    size = per_class(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label, "n", F.col(label))
    return numbered.withColumn("_size", size).select(
        *df.columns, F.coalesce(F.col("_rank") < F.round(F.col("_size") * F.lit(test_fraction)), F.lit(False)).alias("is_test")
    )


def fold_column(df: DataFrame, key: str, folds: int, label: str = "label", seed: int = 42) -> DataFrame:
    """Stratified folds: rank within the class, modulo the number of folds."""
    return ranked(df, "_rank", by=[label], keys=[key], seed=seed).withColumn(
        "fold", F.pmod(F.col("_rank"), F.lit(folds)).cast("int")
    ).drop("_rank")


def undersample(df: DataFrame, key: str, label: str = "label", seed: int = 42, order: str | None = None) -> DataFrame:
    """BAL7: as many rows of each class as the smallest class has. Rows without a class count as a class."""
    smallest = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).scalar()
    return (
        ranked(df, "_rank", by=[label], order=order, keys=[key], seed=seed)
        .withColumn("_least", smallest)
        .where(F.col("_rank") < F.col("_least"))
        .select(*df.columns)
    )


def repeated_undersample(
    df: DataFrame,
    key: str,
    label: str = "label",
    seed: int = 42,
    order: str | None = None,
    all_classes: bool = False,
) -> DataFrame:
    """BAL8: disjoint majority chunks, each beside the whole minority; adds `round_id`.

    Only the largest and the smallest class survive; with ``all_classes=True`` each class but
    the smallest is cut in chunks of the minority's size, for as many rounds as it lasts.
    On equal counts the lower label is taken. Rows without a class are in no round.
    """
    df = df.where(F.col(label).isNotNull())
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(
        F.struct(
            F.min_by(label, F.struct("n", label)).alias("minor"),
            F.max_by(label, F.struct(F.col("n"), -F.col(label))).alias("major"),
            F.min("n").alias("size"),
            F.floor(F.max("n") / F.min("n")).alias("rounds"),
        )
    ).scalar()
    numbered = ranked(df, "_rank", by=[label], order=order, keys=[key], seed=seed).withColumn("_c", ends)
    minor = F.col(label) == F.col("_c.minor")
    chunk = F.floor(F.col("_rank") / F.col("_c.size"))
    large = ~minor if all_classes else (F.col(label) == F.col("_c.major")) & ~minor
    if all_classes:
        numbered = numbered.withColumn("_n", per_class(counts, label, "n", F.col(label)))
        inside = chunk < F.floor(F.col("_n") / F.col("_c.size"))
    else:
        inside = chunk < F.col("_c.rounds")
    majority = numbered.where(large & inside).withColumn("round_id", chunk.cast("int")).select(*df.columns, "round_id")
    few = numbered.where(minor).withColumn("copies", F.col("_c.rounds").cast("bigint")).select(*df.columns, "copies")
    minority = multiplied(few, [key], "round_id").withColumn("round_id", F.col("round_id").cast("int"))
    return majority.unionByName(minority.select(*df.columns, "round_id"))


def multiplied(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Each row `copies` times, numbered from 0 in `out`.

    One row may owe millions of copies, so they are first dealt out in chunks over the
    cluster and only then multiplied.
    """
    last = F.floor((F.col("copies") - 1) / F.lit(COPIES_PER_TASK_ROW)).cast("bigint")
    dealt = (
        df.where("copies > 0")
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .repartition(*keys, "_chunk")
    )
    first = F.col("_chunk") * COPIES_PER_TASK_ROW
    upto = F.least(F.col("copies"), first + COPIES_PER_TASK_ROW) - 1
    return dealt.withColumn(out, F.explode(F.sequence(first, upto))).drop("_chunk")


def needed(counts: Mapping[int, int], strategy: str | float | Mapping[int, int] = "auto") -> dict[int, int]:
    """How many rows each class lacks under a sampling strategy.

    'auto': every class but the largest up to the largest; 'minority': the smallest only; a
    number: the smallest up to that share of the largest; a mapping: the given class sizes.
    """
    largest = max(counts.values())
    major = min(c for c, n in counts.items() if n == largest)
    smallest = min(counts, key=lambda c: (counts[c], c))
    if isinstance(strategy, Mapping):
        target = dict(strategy)
    elif strategy == "auto":
        target = {c: largest for c in counts if c != major}
    elif strategy == "minority":
        target = {smallest: largest}
    else:
        target = {smallest: int(float(strategy) * largest)}
    return {c: t - counts[c] for c, t in target.items() if t > counts[c]}


def _uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) fixed by a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(2**53))


def _vectors(df: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("features"))


def _interpolate(
    seeds: DataFrame,
    members: DataFrame,
    k: int,
    seed: int,
) -> DataFrame:
    """Synthetic vectors: `seeds` (id, features, copies) moved part-way to a random near member."""
    near = (
        nearest(seeds, members, k)
        .select("id", F.posexplode("neighbors").alias("_p", "_nn"))
        .select("id", F.col("_nn.id").alias("_to"))
        .join(members.select(F.col("id").alias("_to"), F.col("features").alias("_vec")), "_to")
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("_to", "_vec"))).alias("_near"))
    )
    copies = multiplied(seeds.join(near, "id"), ["id"], "copy")
    choice = F.pmod(F.xxhash64("id", "copy", F.lit(seed)), F.size("_near"))
    step = _uniform("id", "copy", F.lit(seed + 1))
    return copies.withColumns({"_to": F.get("_near", choice.cast("int"))["_vec"], "_step": step}).select(
        "id", "copy", F.zip_with("features", "_to", lambda a, b: a + F.col("_step") * (b - a)).alias("features")
    )


def _synthetic_rows(
    df: DataFrame,
    made: DataFrame,
    features: Sequence[str],
    key: str,
    label: str,
    value: int,
    device: str,
) -> DataFrame:
    """BAL11: interpolated vectors as full rows; other columns come from the seed row."""
    keep = [c for c in df.columns if c not in features]
    source = df.select(F.col(key).alias("_id"), *keep)
    rows = made.join(source, made["id"] == source["_id"])
    columns = []
    for name in df.columns:
        kind = df.schema[name].dataType
        if name in features:
            columns.append(F.get("features", F.lit(list(features).index(name))).alias(name))
        elif name == label:
            columns.append(F.lit(value).cast(kind).alias(name))
        elif name == device and isinstance(kind, T.StringType):
            columns.append(F.concat(F.col(device), F.lit("_synthetic")).alias(name))
        else:
            columns.append(F.col(name))
    return rows.select(*columns, F.lit(True).alias("synthetic"), F.col("copy"))


def _with_doubles(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in features})


def _originals(df: DataFrame) -> DataFrame:
    return df.withColumns({"synthetic": F.lit(False), "copy": F.lit(None).cast("bigint")})


def _even_shares(members: DataFrame, need: int, size: int, seed: int) -> DataFrame:
    """`need` copies dealt evenly over the rows of a class, the remainder by hash order."""
    each, rest = divmod(need, size)
    numbered = ranked(members, "_rank", keys=["id"], seed=seed)
    return numbered.withColumn(
        "copies", F.lit(each).cast("bigint") + (F.col("_rank") < rest).cast("bigint")
    ).drop("_rank")


def smote(
    df: DataFrame,
    features: Sequence[str],
    key: str,
    label: str = "label",
    k: int = 3,
    seed: int = 42,
    strategy: str | float | Mapping[int, int] = "auto",
    device: str = "device_id",
) -> DataFrame:
    """BAL2, SET3: synthetic rows between near members of the same class.

    Adds `synthetic` and `copy`, the number of the copy of its seed row (null for originals).
    """
    df = _with_doubles(df, features)
    counts = class_counts(df, label)
    out = _originals(df)
    for value, lacking in sorted(needed(counts, strategy).items()):
        if counts[value] <= k:
            raise ValueError(f"class {value} has {counts[value]} rows, {k} neighbours need more")
        members = _vectors(df.where(F.col(label) == value), features, key)
        made = _interpolate(_even_shares(members, lacking, counts[value], seed), members, k, seed)
        out = out.unionByName(_synthetic_rows(df, made, features, key, label, value, device))
    return out


def _other_share(df: DataFrame, everything: DataFrame, value: int, label: str, k: int) -> DataFrame:
    """Per row of class `value`: how many of its k nearest rows of any class belong to another."""
    mine = everything.where(F.col("label") == value)
    unlike = F.size(F.filter("neighbors", lambda x: x["payload"] != F.lit(value)))
    return nearest(mine, everything, k, payload="label").select("id", unlike.alias("others"))


def _labelled_vectors(df: DataFrame, features: Sequence[str], key: str, label: str) -> DataFrame:
    return df.select(
        F.col(key).alias("id"),
        F.array(*[F.col(c).cast("double") for c in features]).alias("features"),
        F.col(label).cast("int").alias("label"),
    )


def adasyn(
    df: DataFrame,
    features: Sequence[str],
    key: str,
    label: str = "label",
    k: int = 5,
    seed: int = 42,
    strategy: str | float | Mapping[int, int] = "auto",
    device: str = "device_id",
) -> DataFrame:
    """BAL3: SMOTE where rows with more neighbours of other classes get more copies."""
    df = _with_doubles(df, features)
    counts = class_counts(df, label)
    everything = _labelled_vectors(df, features, key, label)
    out = _originals(df)
    for value, lacking in sorted(needed(counts, strategy).items()):
        members = everything.where(F.col("label") == value).select("id", "features")
        hard = _other_share(df, everything, value, label, k)
        total = hard.agg(F.sum("others")).first()[0]
        if not total:
            raise ValueError(f"no row of class {value} has a neighbour of another class")
        seeds = members.join(hard, "id").withColumn(
            "copies", F.rint(F.col("others") * F.lit(lacking / total)).cast("bigint")
        ).drop("others")
        made = _interpolate(seeds, members, k, seed)
        out = out.unionByName(_synthetic_rows(df, made, features, key, label, value, device))
    return out


def borderline_smote(
    df: DataFrame,
    features: Sequence[str],
    key: str,
    label: str = "label",
    k: int = 5,
    m: int = 10,
    seed: int = 42,
    strategy: str | float | Mapping[int, int] = "auto",
    device: str = "device_id",
) -> DataFrame:
    """BAL4: SMOTE from rows whose `m` neighbours are half or more, but not all, of other classes."""
    df = _with_doubles(df, features)
    counts = class_counts(df, label)
    everything = _labelled_vectors(df, features, key, label)
    out = _originals(df)
    for value, lacking in sorted(needed(counts, strategy).items()):
        members = everything.where(F.col("label") == value).select("id", "features")
        hard = _other_share(df, everything, value, label, m)
        danger = members.join(hard.where((F.col("others") * 2 >= m) & (F.col("others") < m)).select("id"), "id")
        size = danger.count()
        if not size:
            continue
        made = _interpolate(_even_shares(danger, lacking, size, seed), members, k, seed)
        out = out.unionByName(_synthetic_rows(df, made, features, key, label, value, device))
    return out


def _identified(df: DataFrame, key: str) -> DataFrame:
    """An id per row of a resampled table, originals and copies alike: the key, then the copy's number after the last #."""
    return df.withColumn("_id", F.concat_ws("#", F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce("copy", F.lit(-1)).cast("string")))


def drop_mislabelled(df: DataFrame, features: Sequence[str], id: str, label: str = "label", k: int = 3) -> DataFrame:
    """Edited nearest neighbours: rows stay when all their k neighbours share their label."""
    vectors = _labelled_vectors(df, features, id, label)
    agree = nearest(vectors, vectors, k, payload="label").join(vectors.select("id", "label"), "id").where(
        F.forall("neighbors", lambda x: x["payload"] == F.col("label"))
    )
    return df.join(agree.select(F.col("id").alias(id)), id, "left_semi").select(*df.columns)


def drop_tomek_links(df: DataFrame, features: Sequence[str], id: str, label: str = "label") -> DataFrame:
    """Drops both ends of every pair of mutual nearest neighbours with different labels."""
    vectors = _labelled_vectors(df, features, id, label)
    first = nearest(vectors, vectors, 1, payload="label").join(vectors.select("id", "label"), "id").select(
        "id", "label", F.get("neighbors", F.lit(0)).alias("nn")
    ).select("id", F.col("nn.id").alias("to"), (F.col("label") != F.col("nn.payload")).alias("unlike"))
    unlike = first.where("unlike").select("id", "to")
    linked = unlike.join(unlike.select(F.col("id").alias("to"), F.col("to").alias("id")), ["id", "to"], "left_semi")
    return df.join(linked.select(F.col("id").alias(id)), id, "left_anti").select(*df.columns)


def smote_enn(df: DataFrame, features: Sequence[str], key: str, label: str = "label", k: int = 5, **options) -> DataFrame:
    """BAL5: SMOTE, then edited nearest neighbours over all rows."""
    grown = _identified(smote(df, features, key, label, k=k, **options), key)
    return drop_mislabelled(grown, features, "_id", label).drop("_id")


def smote_tomek(df: DataFrame, features: Sequence[str], key: str, label: str = "label", k: int = 5, **options) -> DataFrame:
    """BAL6: SMOTE, then removal of Tomek links."""
    grown = _identified(smote(df, features, key, label, k=k, **options), key)
    return drop_tomek_links(grown, features, "_id", label).drop("_id")


def choose_method(df: DataFrame, label: str = "label", limit: float = 2.0) -> str:
    """BAL10: SMOTE when classes differ by more than `limit`, else nothing."""
    return "smote" if imbalance_ratio(df, label) > limit else "none"


def balance(
    df: DataFrame,
    features: Sequence[str],
    key: str,
    method: str = "smote",
    label: str = "label",
    seed: int = 42,
    strategy: str | float | Mapping[int, int] = "auto",
) -> DataFrame:
    """Rebalance by name: the method asked for, or an error where it cannot handle the table.

    For a minority of very few rows, "repeated_undersample" pairs it with chunks of the majority instead.
    """
    makers = {
        "smote": smote,
        "adasyn": adasyn,
        "borderline_smote": borderline_smote,
        "smoteenn": smote_enn,
        "smotetomek": smote_tomek,
    }
    if method == "none":
        return df
    if method == "undersample":
        return undersample(df, key, label, seed)
    if method == "repeated_undersample":
        return repeated_undersample(df, key, label, seed)
    if method not in makers:
        raise ValueError(f"no method {method!r}; there are none, undersample, repeated_undersample, {', '.join(makers)}")
    return makers[method](df, features, key, label=label, seed=seed, strategy=strategy)
