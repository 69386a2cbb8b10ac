"""Answer tables: validation, comparison by column content, scoring, voting and agreement.

Tables are compared as multisets of column contents: names, row order and column order don't matter. A column is never
sorted or collected; its signature is made of sums over its cells' hashes, which one aggregate takes for all columns. Where
equal signatures aren't enough, their cells' counts are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesense.functions.cells import EMPTY, NUMBERS, is_emptyish, match_token, number_token, value_label


def _ordinal(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def cell_hashes(token: Column) -> list[Column]:
    """Four numbers of 24 bits from two hashes of a token: sums of them over a column don't overflow below 2^39 rows."""
    h, other = F.xxhash64(token), F.xxhash64(F.lit(7), token)
    low = F.lit((1 << 24) - 1).cast("long")
    return [h.bitwiseAND(low), F.shiftrightunsigned(h, 40), other.bitwiseAND(low), F.shiftrightunsigned(other, 40)]


Hashes = Callable[[Column], Sequence[Column]]


def _fingerprint(n: Column, sums: Sequence[Column]) -> Column:
    zero = F.lit(0).cast("long")
    return F.sha2(F.concat_ws("|", n, *[F.coalesce(s, zero) for s in sums]).cast("binary"), 256)


def _wide_signatures(df: DataFrame, tolerance: float, hashes: Hashes = cell_hashes, counted: Callable[[Column], Column] | None = None) -> DataFrame:
    """One aggregate over the table as it is: nothing but a row per partition is shuffled."""
    places = range(len(df.columns))
    token = lambda i: (number_token if df.dtypes[i][1] in NUMBERS else match_token)(F.col(f"c{i}"), tolerance)
    tokens = _ordinal(df).select(*[token(i).alias(f"c{i}") for i in places])
    if counted:
        tokens = tokens.select(*[F.when(counted(F.col(f"c{i}")), F.col(f"c{i}")).alias(f"c{i}") for i in places])
    parts = [hashes(F.col(f"c{i}")) for i in places]
    hashed = tokens.select(*[F.when(F.col(f"c{i}").isNotNull(), F.struct(*[p.alias(f"h{j}") for j, p in enumerate(parts[i])])).alias(f"c{i}") for i in places])
    sums = hashed.agg(*[F.struct(F.lit(i).alias("col_idx"), _fingerprint(F.count(f"c{i}"), [F.sum(f"c{i}.h{j}") for j in range(len(parts[i]))]).alias("signature")).alias(f"c{i}") for i in places])
    return sums.select(F.explode(F.array(*[f"c{i}" for i in places])).alias("s")).select("s.col_idx", "s.signature")


def signatures(df: DataFrame, tolerance: float = 1e-2, hashes: Hashes = cell_hashes) -> DataFrame:
    """col_idx, signature: equal for columns with the same cells as often. Tables may have columns of the same name.

    A signature is a count and sums of hashes; ``column_classes`` says which columns of equal signatures have equal cells."""
    if not df.columns:
        return df.sparkSession.createDataFrame([], "col_idx int, signature string")
    return _wide_signatures(df, tolerance, hashes)


def signed(cells: DataFrame, *keys: str, hashes: Hashes = cell_hashes) -> DataFrame:
    """keys, signature: of columns given as cells (keys, token), the same as ``signatures`` has. A null token is no cell; it says
    that its column is there, so that columns without cells have a signature too, all the same one."""
    sums = [F.sum(F.when(F.col("token").isNotNull(), h)) for h in hashes(F.col("token"))]
    return cells.groupBy(*keys).agg(_fingerprint(F.count("token"), sums).alias("signature"))


def column_classes(tables: Sequence[DataFrame], tolerance: float = 1e-2, hashes: Hashes = cell_hashes) -> DataFrame:
    """table_no, col_idx, class_no: columns of one class have the same cells as often, cell by cell; the class is numbered by its
    first column, counted over all tables.

    Signatures choose candidates, of which there are as many rows as columns. Columns alone in their signature are done; the others
    are confirmed: cells are counted, and each column's counts are joined with those of its candidate class's first column by a
    full outer join on the token. A column with a count that differs or is missing on either side is no member; such columns
    are tried among themselves, until none is left over. Columns without cells (of tables without rows) are equal.
    """
    spark = next(iter(tables)).sparkSession
    sigs = [r for i, df in enumerate(tables) for r in signatures(df, tolerance, hashes).withColumn("t", F.lit(i)).collect()]
    order = {c: n for n, c in enumerate(sorted((r["t"], r["col_idx"]) for r in sigs))}
    pending: dict[int, list[int]] = {}
    for members in _grouped((r["signature"], order[r["t"], r["col_idx"]]) for r in sigs).values():
        pending[members[0]] = members
    done: dict[int, int] = {}
    place = {n: c for c, n in order.items()}
    while pending:
        done.update({m: first for first, members in pending.items() for m in members[:1]})
        again = {first: members for first, members in pending.items() if len(members) > 1}
        if not again:
            break
        equal = _equal_to_first(spark, tables, again, place, tolerance)
        done.update({m: first for first, members in again.items() for m in members if m in equal})
        pending = {left[0]: left for members in again.values() if (left := [m for m in members[1:] if m not in equal])}
    return spark.createDataFrame([(*place[m], first) for m, first in done.items()], "table_no int, col_idx int, class_no int")


def _grouped(pairs) -> dict:
    found: dict = {}
    for key, value in sorted(pairs):
        found.setdefault(key, []).append(value)
    return found


def _equal_to_first(spark, tables: Sequence[DataFrame], classes: Mapping[int, list[int]], place: Mapping[int, tuple[int, int]], tolerance: float) -> set[int]:
    """Which members of candidate classes have the same cells as often as the first of their class."""
    wanted = _grouped((place[m][0], (place[m][1], m)) for members in classes.values() for m in members)
    cells = []
    for t, columns in wanted.items():
        own, types = _ordinal(tables[t]), [kind for _, kind in tables[t].dtypes]
        value = lambda i, to, fits: (F.col(f"c{i}").cast(to) if fits else F.lit(None).cast(to)).alias(to)
        cell = F.array(*[F.struct(F.lit(m).alias("member"), value(i, "double", types[i] in NUMBERS), value(i, "string", types[i] not in NUMBERS)) for i, m in columns])
        cells.append(own.select(F.explode(cell).alias("c")).select("c.*"))
    # equal values are counted before they become tokens, so that a value becomes one once
    values = reduce(DataFrame.unionByName, cells).groupBy("member", "double", "string").agg(F.count("*").alias("n"))
    token = F.when(F.col("double").isNotNull(), number_token(F.col("double"), tolerance)).otherwise(match_token(F.col("string"), tolerance))
    counts = values.select("member", token.alias("token"), "n").groupBy("member", "token").agg(F.sum("n").alias("n"))
    first_of = spark.createDataFrame([(m, first) for first, members in classes.items() for m in members], "m int, first int")  # a row per column
    counted = counts.join(F.broadcast(first_of), F.col("member") == F.col("m")).select("member", "first", "token", "n")
    own = counted.where("member <> first")
    heads = counted.where("member = first").select(F.col("first").alias("f"), F.col("token").alias("t"), F.col("n").alias("k"))
    others = F.broadcast(first_of.where("m <> first"))
    expected = heads.join(others, F.col("f") == F.col("first")).select(F.col("m").alias("of"), "t", "k")
    joined = own.join(expected, (F.col("member") == F.col("of")) & F.col("token").eqNullSafe(F.col("t")), "full")
    odd = joined.where(~F.col("n").eqNullSafe(F.col("k"))).select(F.coalesce("member", "of").alias("m")).distinct()
    unequal = {r["m"] for r in odd.collect()}
    return {m for first, members in classes.items() for m in members if m == first or m not in unequal}


def match_columns(gold: DataFrame, prediction: DataFrame, tolerance: float = 1e-2, exact: bool = False) -> DataFrame:
    """gold_idx, pred_idx: a largest set of pairs of equal columns. Equality parts columns into classes, and a class of g
    gold and p predicted columns has min(g, p) pairs, the i-th gold with the i-th last of as many predicted ones. Classes are those of
    equal signatures, or with ``exact`` of equal cells."""
    if exact:
        sides = column_classes([gold, prediction], tolerance).select("table_no", "col_idx", F.col("class_no").alias("signature"))
        sides = [sides.where(F.col("table_no") == i).drop("table_no") for i in (0, 1)]
    else:
        sides = [signatures(gold, tolerance), signatures(prediction, tolerance)]
    place = Window.partitionBy("signature").orderBy("col_idx")
    g = sides[0].withColumn("i", F.row_number().over(place) - 1).withColumn("g", F.count("*").over(Window.partitionBy("signature")))
    p = sides[1].withColumn("j", F.row_number().over(place) - 1).withColumn("p", F.count("*").over(Window.partitionBy("signature")))
    pairs = g.alias("x").join(p.alias("y"), "signature").withColumn("t", F.least("g", "p"))
    return pairs.where((F.col("i") < F.col("t")) & (F.col("j") == F.col("t") - 1 - F.col("i"))).select(F.col("x.col_idx").alias("gold_idx"), F.col("y.col_idx").alias("pred_idx"))


def score(matched: Column, gold: Column, predicted: Column, penalty: float = 0.5) -> Column:
    """Recall less the share of superfluous columns times ``penalty``, 0 at least; without gold columns 0."""
    recall = F.coalesce(F.try_divide(matched, gold), F.lit(0.0))
    extra = F.coalesce(F.try_divide(predicted - matched, predicted), F.lit(0.0))
    return F.when(gold == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), recall - penalty * extra))


def score_table(gold: DataFrame, prediction: DataFrame, tolerance: float = 1e-2, penalty: float = 0.5) -> DataFrame:
    """matched, gold_columns, pred_columns, recall, score: one row."""
    found = match_columns(gold, prediction, tolerance).agg(F.count("*").alias("matched"))
    counted = found.select("matched", F.lit(len(gold.columns)).cast("long").alias("gold_columns"), F.lit(len(prediction.columns)).cast("long").alias("pred_columns"))
    recall = F.coalesce(F.try_divide("matched", "gold_columns"), F.lit(0.0))
    return counted.select("*", F.round(recall, 6).alias("recall"), F.round(score(F.col("matched"), F.col("gold_columns"), F.col("pred_columns"), penalty), 6).alias("score"))


def strict_match(gold: DataFrame, prediction: DataFrame, tolerance: float = 1e-2) -> DataFrame:
    """correct: whether every gold column is among the predicted ones, empty cells left out and multiplicity aside."""

    def full(df: DataFrame) -> DataFrame:
        if not df.columns:
            return df.sparkSession.createDataFrame([], "sig string")
        return _wide_signatures(df, tolerance, counted=lambda t: ~t.isin(EMPTY, "nan")).select(F.col("signature").alias("sig"))

    missing = full(gold).join(full(prediction), "sig", "left_anti")
    return missing.agg((F.count("*") == 0).alias("correct"))


def score_run(tasks: DataFrame, gold: DataFrame, predictions: DataFrame, penalty: float = 0.5) -> DataFrame:
    """Scores of many tasks at once. tasks: task_id; gold and predictions: task_id, col_idx, signature (-1: a table without
    columns). Returns task_id, error, gold_columns, pred_columns, matched, score; a missing side is named and scores 0."""
    g = gold.where("col_idx >= 0").groupBy("task_id", "signature").agg(F.count("*").alias("g"))
    p = predictions.where("col_idx >= 0").groupBy("task_id", "signature").agg(F.count("*").alias("p"))
    matched = g.join(p, ["task_id", "signature"]).groupBy("task_id").agg(F.sum(F.least("g", "p")).alias("matched"))
    width = lambda df, name: df.groupBy("task_id").agg(F.count_if(F.col("col_idx") >= 0).alias(name))
    joined = tasks.join(width(gold, "gold_columns"), "task_id", "left").join(width(predictions, "pred_columns"), "task_id", "left").join(matched, "task_id", "left")
    error = F.when(F.col("gold_columns").isNull(), "missing_gold").when(F.col("pred_columns").isNull(), "missing_prediction")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("gold_columns", "pred_columns", "matched")}
    scored = joined.withColumn("error", error).withColumns(counts)
    return scored.select("task_id", "error", "gold_columns", "pred_columns", "matched", F.round(F.when(F.col("error").isNotNull(), 0.0).otherwise(score(F.col("matched"), F.col("gold_columns"), F.col("pred_columns"), penalty)), 6).alias("score"))


def run_summary(scores: DataFrame) -> DataFrame:
    """Means over all tasks, failed ones as 0; 0 for no tasks."""
    recall = F.coalesce(F.try_divide("matched", "gold_columns"), F.lit(0.0))
    return scores.agg(F.count("*").alias("tasks"), F.count_if(F.col("error").isNull()).alias("scored"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("mean_score"), F.round(F.coalesce(F.avg(recall), F.lit(0.0)), 6).alias("mean_recall"))


def validation_issues(df: DataFrame) -> DataFrame:
    """code, severity, col_idx: no_columns, no_rows, empty_column (errors) and mixed_types (a warning), from one aggregate."""
    spark = df.sparkSession
    schema = "code string, severity string, col_idx int"
    if not df.columns:
        return spark.createDataFrame([("no_columns", "error", None)], schema)
    cells = _ordinal(df)
    labels = [F.array_remove(F.array_remove(F.collect_set(value_label(F.col(c))), "null"), "empty") for c in cells.columns]
    found = cells.agg(F.count("*").alias("rows"), *[F.count_if(~is_emptyish(F.col(c))).alias(f"full{i}") for i, c in enumerate(cells.columns)], *[F.size(x).alias(f"kinds{i}") for i, x in enumerate(labels)])
    said = [F.when(F.col("rows") == 0, F.struct(F.lit("no_rows").alias("code"), F.lit("error").alias("severity"), F.lit(None).cast("int").alias("col_idx")))]
    for i in range(len(cells.columns)):
        said.append(F.when((F.col("rows") > 0) & (F.col(f"full{i}") == 0), F.struct(F.lit("empty_column").alias("code"), F.lit("error").alias("severity"), F.lit(i).alias("col_idx"))))
        said.append(F.when(F.col(f"kinds{i}") > 1, F.struct(F.lit("mixed_types").alias("code"), F.lit("warning").alias("severity"), F.lit(i).alias("col_idx"))))
    return found.select(F.explode(F.filter(F.array(*said), lambda x: x.isNotNull())).alias("i")).select("i.*")


def ragged_rows(df: DataFrame, cells: str, width: int, pos: str) -> DataFrame:
    """Rows of the wrong width: code, severity, pos, width."""
    return df.where(F.size(cells) != width).select(F.lit("ragged_row").alias("code"), F.lit("error").alias("severity"), F.col(pos).alias("pos"), F.size(cells).alias("width"))


def sample_signatures(samples: list[DataFrame], tolerance: float = 1e-2) -> DataFrame:
    """sample_id, col_idx, signature of several answers."""
    return reduce(DataFrame.unionByName, [signatures(s, tolerance).withColumn("sample_id", F.lit(i)) for i, s in enumerate(samples)]).select("sample_id", "col_idx", "signature")


def column_votes(sigs: DataFrame) -> DataFrame:
    """signature, votes: a sample votes for a signature once, however many of its columns have it."""
    return sigs.select("sample_id", "signature").distinct().groupBy("signature").agg(F.count("*").alias("votes"))


def modal_width(sigs: DataFrame) -> DataFrame:
    """width: the number of columns that most samples have, the larger on a tie."""
    widths = sigs.groupBy("sample_id").agg(F.count("*").alias("width"))
    return widths.groupBy("width").agg(F.count("*").alias("n")).agg(F.max_by("width", F.struct("n", "width")).alias("width"))


def vote_winners(sigs: DataFrame, least: int = 2) -> DataFrame:
    """signature, votes, rank: the signatures with ``least`` votes or more, the most voted first, at most the modal width of them."""
    rank = F.row_number().over(Window.orderBy(F.desc("votes"), "signature"))
    ranked = column_votes(sigs).where(F.col("votes") >= least).withColumn("rank", rank)
    return ranked.crossJoin(F.broadcast(modal_width(sigs))).where(F.col("rank") <= F.col("width")).select("signature", "votes", "rank")


def best_sample(sigs: DataFrame, winners: DataFrame) -> DataFrame:
    """sample_id, coverage, extras: the sample with most winning columns, then fewest others, then the first."""
    marked = sigs.join(winners.select("signature", F.lit(1).alias("won")), "signature", "left")
    each = marked.groupBy("sample_id").agg(F.count_distinct(F.when(F.col("won") == 1, F.col("signature"))).alias("coverage"), F.count_distinct("signature").alias("width"))
    each = each.withColumn("extras", F.col("width") - F.col("coverage"))
    return each.orderBy(F.desc("coverage"), "extras", "sample_id").limit(1).select("sample_id", "coverage", "extras")


def agreed_columns(primary: DataFrame, verifiers: DataFrame, agreement: int = 2) -> DataFrame:
    """col_idx: columns of the primary answer whose signature ``agreement - 1`` of the others have or more."""
    seen = verifiers.select("sample_id", "signature").distinct().groupBy("signature").agg(F.count("*").alias("n"))
    return primary.join(seen, "signature", "left").where(F.coalesce("n", F.lit(0)) >= agreement - 1).select("col_idx")


def projected(df: DataFrame, places: Sequence[int]) -> DataFrame:
    """Columns by their places, in that order; names may repeat."""
    return _ordinal(df).select(*[F.col(f"c{i}").alias(df.columns[i]) for i in places])


def _known(sigs: DataFrame) -> DataFrame:
    """Signatures as local rows, a row per column of an answer, so that the answers are read once."""
    return sigs.sparkSession.createDataFrame(sigs.collect(), "sample_id int, col_idx int, signature string")


def voted_answer(samples: Sequence[DataFrame], least: int = 2, tolerance: float = 1e-2) -> tuple[DataFrame | None, int | None]:
    """The answer most samples agree on, and which sample it comes from: the best sample's columns that won the vote, the most
    voted first, then in its own order. Without winners the first sample's columns are wanted; a best sample that lacks a
    wanted column is given whole. No samples: (None, None)."""
    if not samples:
        return None, None
    sigs = _known(sample_signatures(list(samples), tolerance))
    votes = {w["signature"]: w["votes"] for w in vote_winners(sigs, max(least, 1)).collect()}
    wanted = list(votes) or [s["signature"] for s in sigs.where("sample_id = 0").orderBy("col_idx").collect()]
    if not wanted:
        return samples[0], 0
    chosen = best_sample(sigs, sigs.sparkSession.createDataFrame([(s,) for s in sorted(set(wanted))], "signature string")).first()["sample_id"]
    own = {s["signature"]: s["place"] for s in sigs.where(F.col("sample_id") == chosen).groupBy("signature").agg(F.min("col_idx").alias("place")).collect()}
    if not set(wanted) <= set(own) or (chosen == 0 and not votes):
        return samples[chosen], chosen
    places = sorted((own[s] for s in votes), key=lambda p: (-next(votes[s] for s in votes if own[s] == p), p)) if votes else [own[s] for s in wanted]
    return projected(samples[chosen], places), chosen


def intersected_answer(primary: DataFrame, verifiers: Sequence[DataFrame], agreement: int = 2, tolerance: float = 1e-2) -> DataFrame:
    """The primary answer's columns that ``agreement - 1`` verifiers or more have too; all of it where there is none."""
    sigs = _known(sample_signatures([primary, *verifiers], tolerance))
    agreed = agreed_columns(sigs.where("sample_id = 0"), sigs.where("sample_id > 0"), agreement)
    places = sorted(r["col_idx"] for r in agreed.collect())
    return projected(primary, places) if places else primary


def stamped(answer: object, succeeded: bool, reason: str | None = None) -> tuple[bool, str | None, list[str]]:
    """Whether a task succeeded once its answer is looked at, why not, and the codes of its errors: missing_answer (None),
    invalid_answer_type (not a table), or those of ``validation_issues``. What failed before stays failed, for its own reason."""
    if answer is None:
        codes = ["missing_answer"]
    elif not isinstance(answer, DataFrame):
        codes = ["invalid_answer_type"]
    else:
        codes = [r["code"] for r in validation_issues(answer).where("severity = 'error'").orderBy("col_idx", "code").collect()]
    if not codes or not succeeded:
        return succeeded, reason, codes
    said = "invalid_answer: " + "; ".join(codes)
    return False, f"{reason} | {said}" if reason else said, codes
