"""Checks of queries by Spark's own analysis, repairs of specifications, and guarded SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesense.functions.names import close_names, name_ratio, plain_name
from tablesense.operators.answers import validation_issues
from tablesense.operators.relational import drop_empty_columns
from tablesense.plans.spec import Filter, QuerySpec, compile_spec

#: What Spark's error conditions are called here.
CODES = {
    "UNRESOLVED_COLUMN": "no_such_column",
    "UNRESOLVED_USING_COLUMN_FOR_JOIN": "bad_join_key",
    "TABLE_OR_VIEW_NOT_FOUND": "no_such_table",
    "PATH_NOT_FOUND": "no_such_file",
    "PARSE_SYNTAX_ERROR": "sql_syntax",
    "DATATYPE_MISMATCH": "bad_join_key",
    "CAST_INVALID_INPUT": "bad_cast",
    "DIVIDE_BY_ZERO": "division_by_zero",
    "INVALID_ARRAY_INDEX": "index_out_of_range",
}
LEAST_RATIO = 0.68


@dataclass(frozen=True)
class Issue:
    code: str
    message: str
    name: str | None = None
    suggestions: tuple[str, ...] = ()


def issue_of(error: Exception) -> Issue:
    """An error of Spark or of Python as an issue with a code."""
    if isinstance(error, PySparkException):
        condition = (error.getCondition() or "").split(".")[0]
        about = error.getMessageParameters() or {}
        name = (about.get("objectName") or about.get("relationName") or about.get("path") or "").replace("`", "") or None
        said = tuple(x.strip().strip("`").split("`.`")[-1] for x in about.get("proposal", "").split(",") if x.strip())
        return Issue(CODES.get(condition, condition.lower() or "spark_error"), str(error).split("\n")[0], name, said)
    if isinstance(error, KeyError):
        return Issue("no_such_column", f"unknown name {error.args[0]}", str(error.args[0]))
    if isinstance(error, FileNotFoundError):
        return Issue("no_such_file", str(error), str(error.filename or error.args[0]))
    return Issue(type(error).__name__.lower(), str(error))


def check(spec: QuerySpec, sources: Mapping[str, DataFrame]) -> list[Issue]:
    """Issues of a specification: it is analysed, not run."""
    missing = [Issue("no_such_table", f"unknown source {s}", s) for s in [spec.source, *(j.source for j in spec.joins)] if s not in sources]
    if missing:
        return missing
    known = {c for s in [spec.source, *(j.source for j in spec.joins)] for c in sources[s].columns}
    for j in spec.joins:
        bad = [c for c in j.right_on if c not in sources[j.source].columns] + [c for c in j.left_on if c not in known]
        if bad:
            return [Issue("bad_join_key", f"{c} isn't a column of both sides", c) for c in bad]
    try:
        compile_spec(spec, sources).schema  # noqa: B018
    except Exception as error:  # noqa: BLE001
        return [issue_of(error)]
    return []


def close_column(name: str, columns: list[str]) -> str | None:
    """The one column that a name can mean: the same but for case and signs, else the only one that is like enough."""
    same = [c for c in columns if plain_name(c) == plain_name(name)]
    if len(same) == 1:
        return same[0]
    like = [c for c in columns if name_ratio(name, c) >= LEAST_RATIO]
    return like[0] if len(like) == 1 else None


def repair_column(spec: QuerySpec, sources: Mapping[str, DataFrame], issue: Issue) -> QuerySpec | None:
    if issue.code not in ("no_such_column", "bad_join_key") or not issue.name:
        return None
    columns = sorted({c for s in [spec.source, *(j.source for j in spec.joins)] if s in sources for c in sources[s].columns})
    found = close_column(issue.name.split(".")[-1], columns)
    return spec.with_column_renamed(issue.name.split(".")[-1], found) if found else None


def repair_keys(spec: QuerySpec, sources: Mapping[str, DataFrame], issue: Issue) -> QuerySpec | None:
    """Keys compared as normalised text, for sides of different types."""
    if issue.code != "bad_join_key" or not spec.joins or all(j.normalise for j in spec.joins):
        return None
    return replace(spec, joins=tuple(replace(j, normalise=True) for j in spec.joins))


def repair_source(spec: QuerySpec, sources: Mapping[str, DataFrame], issue: Issue) -> QuerySpec | None:
    if issue.code != "no_such_table" or not issue.name:
        return None
    found = close_names(issue.name, list(sources), n=1, cutoff=0.6)
    real = next((s for s in sources if found and s.lower() == found[0]), None)
    if real is None:
        return None
    name = lambda s: real if s == issue.name else s
    return replace(spec, source=name(spec.source), joins=tuple(replace(j, source=name(j.source)) for j in spec.joins))


def repair_join_key(spec: QuerySpec, sources: Mapping[str, DataFrame], issue: Issue) -> QuerySpec | None:
    """For a join whose key isn't on both sides: the one pair of columns whose names are the same but for case and signs, if there is just one,
    else the one pair of ids, named alike but for the table's name or a link to it."""
    if issue.code != "bad_join_key" or not spec.joins:
        return None
    left, fixed = set(sources[spec.source].columns), []
    for j in spec.joins:
        right = sources[j.source].columns
        broken = any(c not in left for c in j.left_on) or any(c not in right for c in j.right_on)
        if broken:
            same = [(a, b) for a in sorted(left) for b in right if plain_name(a) == plain_name(b)]
            own = plain_name(j.source).removesuffix("s")
            ids = [(a, b) for a in sorted(left) for b in right if _id_of(a, own) and _id_of(b, own)]
            pairs = same if len(same) == 1 else ids if not same else []
            if len(pairs) != 1:
                return None
            j = replace(j, left_on=(pairs[0][0],), right_on=(pairs[0][1],))
        fixed.append(j)
        left |= set(right)
    changed = replace(spec, joins=tuple(fixed))
    return changed if changed != spec else None


def _id_of(column: str, table: str) -> bool:
    """Whether a column is named as the id of a table, or as a link to it: id, race_id, RaceID, link_to_race."""
    name = plain_name(column)
    return name in ("id", f"{table}id", f"linkto{table}") or name.endswith(f"{table}id")


def drop_unknown_join(spec: QuerySpec, sources: Mapping[str, DataFrame], issue: Issue) -> QuerySpec | None:
    """Without a join to a source that isn't there and is like none that is, if the rest doesn't need it."""
    if issue.code != "no_such_table" or spec.source == issue.name:
        return None
    rest = replace(spec, joins=tuple(j for j in spec.joins if j.source != issue.name))
    return rest if rest != spec and not check(rest, sources) else None


FIXERS: tuple[Callable[[QuerySpec, Mapping[str, DataFrame], Issue], QuerySpec | None], ...] = (repair_source, repair_column, repair_join_key, repair_keys, drop_unknown_join)


def loosened(spec: QuerySpec) -> QuerySpec:
    """For a query without rows: filters that ignore case and '.0', and keys that are compared as normalised text."""
    filters = tuple(replace(f, loose=True) if f.op in ("=", "!=", "in") and not isinstance(f.value, bool) else Filter(f.column, "is_true", f.value) if isinstance(f.value, bool) else f for f in spec.filters)
    return replace(spec, filters=filters, joins=tuple(replace(j, normalise=True) for j in spec.joins))


def repaired(spec: QuerySpec, sources: Mapping[str, DataFrame], rounds: int = 3) -> tuple[QuerySpec, list[Issue]]:
    """A specification that passes the checks, as far as up to ``rounds`` repairs go; and the issues met on the way."""
    met: list[Issue] = []
    for _ in range(rounds + 1):
        issues = check(spec, sources)
        if not issues or len(met) >= rounds:
            return spec, met + issues
        met.append(issues[0])
        fixed = next((s for fix in FIXERS if (s := fix(spec, sources, issues[0])) is not None), None)
        if fixed is None or fixed == spec:
            return spec, met
        spec = fixed
    return spec, met


def run_spec(spec: QuerySpec, sources: Mapping[str, DataFrame]) -> DataFrame:
    """The result of the repaired specification; without rows, that of the loosened one. Emptiness is tried on one row."""
    fixed, _ = repaired(spec, sources)
    result = compile_spec(fixed, sources)
    if (fixed.filters or fixed.joins) and result.isEmpty():
        return compile_spec(loosened(fixed), sources)
    return result


def mended_answer(answer: DataFrame) -> tuple[DataFrame, list[str]]:
    """An answer without the columns in which nothing is said, one kept at least, and the codes of the errors that are left. What has no rows or no
    columns can't be mended."""
    codes = lambda df: [r["code"] for r in validation_issues(df).where("severity = 'error'").orderBy("col_idx", "code").collect()]
    met = codes(answer)
    if "empty_column" not in met:
        return answer, met
    mended = drop_empty_columns(answer)
    return mended, codes(mended)


#: What a statement's parsed tree may hold: relations and operators of queries, and what describes them. Whatever isn't here
#: isn't run, so commands that a later version of Spark adds are refused.
READING_NODES = frozenset(
    """Project Filter UnresolvedHaving Aggregate Sort GlobalLimit LocalLimit Offset Distinct Join AsOfJoin LateralJoin Union Except Intersect Generate
    Window Sample Expand Unpivot UnresolvedPivot Pivot WithWindowDefinition SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedWith CTERelationDef
    CTERelationRef UnresolvedRelation UnresolvedInlineTable UnresolvedTableValuedFunction UnresolvedTVFAliases OneRowRelation OneRowRelation$ LocalRelation Range
    RelationTimeTravel UnresolvedOrdinal DescribeRelation DescribeColumn DescribeQueryCommand ShowTables ShowColumns ShowNamespaces ShowViews UnresolvedTable
    UnresolvedTableOrView UnresolvedView UnresolvedNamespace CurrentNamespace CurrentNamespace$""".split()
)
#: Groups of Spark's own functions that compute from their arguments and nothing else. The group of miscellaneous ones, which has those that
#: call any method of the JVM, isn't here, nor is what a session has registered itself, which has no group.
COMPUTING_GROUPS = frozenset(
    """agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs generator_funcs hash_funcs
    json_funcs lambda_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs url_funcs variant_funcs window_funcs xml_funcs""".split()
)
COMPUTING_OTHERS = frozenset({"typeof", "equal_null", "try_divide"})
TABLE_FUNCTIONS = frozenset({"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "json_tuple", "stack", "variant_explode", "variant_explode_outer"})


def _nodes(plan) -> Iterator:
    """All nodes of a parsed plan, those of common table expressions and of subqueries in expressions too."""
    yield plan
    for part in (plan.children(), plan.innerChildren(), plan.subqueries()):
        for k in range(part.size()):
            node = part.apply(k)
            if hasattr(node, "subqueries"):
                yield from _nodes(node)
            elif hasattr(node, "_2"):
                yield from _nodes(node._2())


def _expressions(plan) -> Iterator:
    """All expressions of a parsed node, with what they are made of; those of named windows too, which the node has in a map."""
    left = [x for seq in (plan.expressions(),) for x in _listed(seq)]
    if plan.getClass().getSimpleName() == "WithWindowDefinition":
        left += _listed(plan.windowDefinitions().values().toSeq())
    while left:
        one = left.pop()
        yield one
        left += _listed(one.children())


def _listed(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def _refused_calls(spark: SparkSession, plan) -> Iterator[str]:
    """Names of functions of a parsed node that don't just compute; a name that is itself computed is one."""
    catalog = spark._jsparkSession.sessionState().catalog()
    for e in _expressions(plan):
        kind = e.getClass().getSimpleName()
        if "UnresolvedIdentifier" in kind:
            yield "IDENTIFIER"
        elif kind == "UnresolvedFunction":
            parts = [p.lower() for p in _listed(e.nameParts())]
            known = parts[0] in COMPUTING_OTHERS
            if len(parts) == 1 and not known:
                identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(parts[0])
                known = catalog.isBuiltinFunction(identifier) and not catalog.isTemporaryFunction(identifier) and catalog.lookupFunctionInfo(identifier).getGroup() in COMPUTING_GROUPS
            if len(parts) > 1 or not known:
                yield ".".join(parts)
    if plan.getClass().getSimpleName() == "UnresolvedTableValuedFunction":
        name = ".".join(p.lower() for p in _listed(plan.name()))
        if name not in TABLE_FUNCTIONS:
            yield name


def tables_of(spark: SparkSession, sql: str) -> list[str]:
    """Last parts of the names of the tables that a statement reads, in lower case and sorted; its common table expressions aren't tables."""
    read, own = set(), set()
    for node in _nodes(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)):
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            read.add((parts.size(), parts.last().lower()))
        elif kind == "UnresolvedWith":
            relations = node.cteRelations()
            own |= {(1, relations.apply(k)._1().lower()) for k in range(relations.size())}
    return sorted({name for _, name in read - own})


def with_overrides(spec: QuerySpec, overrides: Sequence[Mapping], concepts: Mapping[str, str] | None = None) -> QuerySpec:
    """A specification with filters that were found to be otherwise: an override names a field, or a concept whose column ``concepts`` (lower case)
    says, and a value. Filters of that column take the value; a field without a filter gets one. Overrides without a value change nothing."""
    filters = list(spec.filters)
    for o in overrides:
        name = str(o.get("field") or "").strip()
        meant = {name, (concepts or {}).get(str(o.get("concept") or "").strip().lower(), "")} - {""}
        if not {"new_value", "value"} & set(o):
            continue
        value = o.get("new_value", o.get("value"))
        if any(f.column in meant for f in filters):
            filters = [replace(f, value=value) if f.column in meant else f for f in filters]
        elif name:
            filters.append(Filter(name, "=" if o.get("operator", "==") == "==" else o["operator"], value))
    return replace(spec, filters=tuple(filters))


def read_only_sql(spark: SparkSession, sql: str, limit: int | None = 200) -> tuple[DataFrame, DataFrame]:
    """Rows of a reading statement, at most ``limit`` of them, and whether there are more. The whole parsed tree decides: every
    node of it must be of ``READING_NODES``, and every function one of Spark's own that only compute. Text that doesn't parse raises Spark's error."""
    tree = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    nodes = list(_nodes(tree))
    odd = {name for n in nodes if (name := n.getClass().getSimpleName()) not in READING_NODES}
    odd |= {name for n in nodes if n.getClass().getSimpleName() in READING_NODES for name in _refused_calls(spark, n)}
    if odd:
        raise ValueError(f"only statements that read are run, not {', '.join(sorted(odd))}")
    df = spark.sql(sql)
    if limit is None:
        return df, df.sparkSession.createDataFrame([(False,)], "truncated boolean")
    some = df.limit(limit + 1)
    return df.limit(limit), some.agg((F.count("*") > limit).alias("truncated"))
