"""Guarded SQL: what calls the JVM, writes, or names a function by computing it isn't run."""

import pytest

from tablesense.plans.checks import read_only_sql

CALL = "('java.lang.Integer', 'parseInt', '7')"
REFUSED = [
    f"SELECT reflect{CALL}",
    f"SELECT reflect/**/{CALL}",
    f"SELECT reflect -- a comment\n{CALL}",
    f"SELECT ReFlEcT {CALL}",
    f"SELECT `reflect`{CALL}",
    f"SELECT java_method{CALL}",
    f"SELECT try_reflect{CALL}",
    f"SELECT IDENTIFIER('reflect'){CALL}",
    f"SELECT IDENTIFIER('ref' || 'lect'){CALL}",
    f"SELECT * FROM VALUES (reflect{CALL}) t(x)",
    f"SELECT 1 WHERE EXISTS (SELECT reflect{CALL})",
    f"WITH c AS (SELECT reflect{CALL}) SELECT * FROM c",
    f"SELECT sum(x) OVER w FROM VALUES (1) t(x) WINDOW w AS (PARTITION BY reflect{CALL})",
    f"SELECT transform(array(1), x -> reflect{CALL})",
    f"SELECT count(*) FILTER (WHERE reflect{CALL} = '7') FROM VALUES (1) t(x)",
    f"SELECT * FROM VALUES (1) t(x) JOIN VALUES (2) u(y) ON reflect{CALL} = '7'",
    f"SELECT x FROM VALUES (1) t(x) ORDER BY reflect{CALL}",
    f"SELECT x FROM VALUES (1) t(x) GROUP BY x HAVING reflect{CALL} = '7'",
    f"SELECT x FROM VALUES (1) t(x) LIMIT reflect{CALL}",
    f"SELECT * FROM range(int(reflect{CALL}))",
    f"SELECT * FROM VALUES (1) t(x) LATERAL VIEW explode(array(reflect{CALL})) e",
    "SELECT system.builtin.abs(1)",
    "SELECT own_function(1)",
    "SELECT * FROM own_rows()",
    "DROP TABLE t",
    "SET spark.sql.ansi.enabled = false",
    "SELECT 1; DROP TABLE t",
]
RUN = [
    ("SELECT sum(x) OVER w AS s FROM VALUES (1) t(x) WINDOW w AS (PARTITION BY abs(x))", 1),
    ("WITH c AS (SELECT upper('a') AS x) SELECT length(x) + 1 FROM c", 2),
    ("SELECT aggregate(transform(array(1, 2), x -> x * 2), 0, (a, b) -> a + b)", 6),
    ("SELECT count(*) FROM range(5)", 5),
    ("SELECT 'reflect(1)' AS reflect", "reflect(1)"),
    ("SELECT max(coalesce(nullif(x, 1), -1)) FROM VALUES (1) t(x)", -1),
    ("SELECT CASE WHEN x BETWEEN 0 AND 2 THEN cast(x AS string) END FROM VALUES (1) t(x)", "1"),
    ("SELECT date_add(date'2020-01-30', 2) > date'2020-01-31' AND typeof(1) = 'int'", True),
]


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, sql):
    spark.udf.register("own_function", lambda x: x)
    with pytest.raises(Exception) as raised:  # noqa: PT011
        read_only_sql(spark, sql)
    assert isinstance(raised.value, ValueError) or "PARSE_SYNTAX_ERROR" in str(raised.value)


@pytest.mark.parametrize(("sql", "want"), RUN)
def test_run(spark, sql, want):
    assert read_only_sql(spark, sql)[0].first()[0] == want


def test_an_own_function_under_a_known_name_is_refused(spark):
    own = spark.newSession()
    own.udf.register("lower", lambda x: x)
    with pytest.raises(ValueError, match="lower"):
        read_only_sql(own, "SELECT lower('A')")
    assert read_only_sql(spark, "SELECT lower('A')")[0].first()[0] == "a"
