"""Mixing sources to target weights by hierarchical budgeting.

A token budget is handed down a tree (domain, language, source).  Each node divides its budget among its children by weight; a
child whose whole subtree cannot use its share (its tokens times the largest number of epochs) takes what it can, and the rest
goes to its siblings by weight.  Only what no sibling can take leaves the node, so shortages spread among siblings before
ancestors.  Each leaf then reads its documents in seeded epochs: whole epochs first, and of the last one the prefix, in the seeded
order of that epoch, whose running token count stays within the budget.

The running count is exact without gathering a leaf: the seeded hash deals its rows into cells, a row's count is the tokens of
earlier cells plus its running count in the cell.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from readlake.llm._shared import ROW, Scratch, keeping_names, keyed_rows
from readlake.llm.sharding import _cells

#: Documents have no domain column, so their form stands for it: an expression over the columns of docs, by the length of the text.
DOMAIN = "CASE WHEN length(coalesce(text, '')) < 1000 THEN 'note' WHEN length(text) < 4000 THEN 'article' ELSE 'book' END"
#: Leaves are parameters of a mixture (a few for each source); more than this is an error, not a mixture.
MAX_LEAVES = 100_000
WEIGHTS = {("note",): 1.0, ("article",): 3.0, ("book",): 2.0, "lang": {"en": 5.0, "de": 3.0, "fr": 3.0, "es": 2.0}}


def weight_of(path: Sequence, weights: Mapping) -> float:
    """The weight of a node among its siblings: by its path, else for a language by its name, else 1."""
    if tuple(path) in weights:
        return weights[tuple(path)]
    return weights.get("lang", {}).get(path[-1], 1.0) if len(path) == 2 else 1.0


def water_fill(budget: float, shares: Sequence[float], room: Sequence[float]) -> list[float]:
    """Divide budget by shares, never above room; what one cannot take goes to the others by share."""
    out = [0.0] * len(shares)
    open_ = [i for i in range(len(shares)) if shares[i] > 0 and room[i] > 0]
    while open_ and budget > 1e-9:
        total = sum(shares[i] for i in open_)
        full = [i for i in open_ if out[i] + budget * shares[i] / total >= room[i]]
        if not full:
            for i in open_:
                out[i] += budget * shares[i] / total
            return out
        for i in full:
            budget -= room[i] - out[i]
            out[i] = room[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def budgets(leaves: Mapping[tuple, int], budget: float, weights: Mapping, max_epochs: float) -> dict[tuple, int]:
    """Tokens for each leaf (a path), from the tokens that each has."""
    room: dict[tuple, float] = defaultdict(float)
    children: dict[tuple, set] = defaultdict(set)
    for path, tokens in leaves.items():
        for k in range(len(path) + 1):
            room[path[:k]] += tokens * max_epochs
            if k:
                children[path[: k - 1]].add(path[:k])
    given, todo = {(): min(budget, room[()])}, [()]
    while todo:
        node = todo.pop()
        below = sorted(children[node], key=lambda p: tuple((x is None, x or "") for x in p))
        for path, got in zip(below, water_fill(given[node], [weight_of(p, weights) for p in below], [room[p] for p in below])):
            given[path] = got
            if path in children:
                todo.append(path)
    return {path: int(given.get(path, 0.0) + 1e-6) for path in leaves}


def mix_sources(
    docs: DataFrame, share: float = 0.6, weights: Mapping = WEIGHTS, max_epochs: float = 2.0, seed: int = 11, domain: str = DOMAIN,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", key_col: str | None = None,
) -> DataFrame:
    """One row for each reading of a document: doc_id, domain, lang, source, epoch (from 1), n_tokens, leaf_budget.

    share is the budget as a part of all tokens (words between ASCII white space); domain is an SQL expression over docs.  Null languages and sources are nodes of their
    own; a null text has no tokens and is read only with whole epochs or inside the prefix.  Documents with the same doc_id are
    separate rows.  An empty table gives an empty result.  Other columns are ignored.  key_col, if given, names each row (unique,
    not null) and is returned too.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint").alias("n_tokens"), (F.monotonically_increasing_id() if key_col is None else F.col(key_col)).alias("uid"), F.expr(domain).cast("string").alias("domain"))
    rows = scratch.table(rows, "rows")
    path = ["domain", "lang", "source"]
    found = rows.groupBy(*path).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(found) > MAX_LEAVES:
        raise ValueError(f"the tree has over {MAX_LEAVES} leaves; choose coarser domains or sources")
    tokens = {(r.domain, r.lang, r.source): r.tokens for r in found}
    given = budgets(tokens, share * sum(tokens.values()), weights, max_epochs)
    leaf_rows = [(*p, given[p], given[p] // t if t else 0, given[p] % t if t else 0) for p, t in tokens.items()]
    leaves = spark.createDataFrame(leaf_rows, T.StructType.fromDDL("d string, l string, s string, leaf_budget bigint, whole bigint, rest bigint"))
    on = F.col("domain").eqNullSafe(F.col("d")) & F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))
    rows = rows.join(F.broadcast(leaves), on).drop("d", "l", "s")  # at most MAX_LEAVES rows
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), F.col("whole") + 1, "doc_id", "n_tokens"))
    cells = _cells(sum(r.n for r in found))
    rows = rows.withColumn("cell", F.pmod("h", F.lit(cells)))
    leaf = [F.coalesce(F.col(c), F.lit("")).alias(f"{c}_key") for c in path] + [F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in path]).alias("null_key")]
    rows = rows.select("*", *leaf)
    key = [f"{c}_key" for c in path] + ["null_key"]
    sums = rows.groupBy(*key, "cell").agg(F.sum("n_tokens").alias("in_cell"))
    sums = sums.withColumn("before", F.sum("in_cell").over(Window.partitionBy(*key).orderBy("cell")) - F.col("in_cell")).drop("in_cell")
    running = F.sum("n_tokens").over(Window.partitionBy(*key, "cell").orderBy("h", "doc_id", "uid").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("running", running).join(sums, [*key, "cell"])
    times = F.col("whole") + (F.col("before") + F.col("running") <= F.col("rest")).cast("bigint")
    rows = rows.withColumn("times", times.cast("int")).where("times > 0")
    named = [] if key_col is None else [F.col("uid").alias(key_col)]
    return rows.select(*named, "doc_id", *path, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("epoch"), "n_tokens", "leaf_budget")


@keeping_names
def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that mix_sources reads, once for each reading, with all their columns.

    Null and repeated doc_ids are rows like any other; null texts have no tokens, null languages and sources are nodes of their own.
    An empty table gives an empty result.  Columns may have any names.
    """
    rows = keyed_rows(docs)
    return rows.join(mix_sources(rows, key_col=ROW, **how).select(ROW), ROW).drop(ROW)
