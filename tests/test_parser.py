import pytest

from brindle.plans import syntax as S


def test_clauses_in_any_page_order():
    a = S.parse("SELECT a FROM t ORDER BY a LIMIT 3 OFFSET 2")
    b = S.parse("SELECT a FROM t ORDER BY a OFFSET 2 LIMIT 3")
    assert (a.limit, a.offset) == (b.limit, b.offset) == (3, 2)


@pytest.mark.parametrize(
    "cond",
    ["a = 1 OR b = 2 AND NOT c LIKE 'x%'", "a <> 'x AND y'", "a NOT IN (1, 2)", "a NOT BETWEEN 1 AND 2", "LOWER(a) = \"a>b\"", "(a = 1 OR b = 2) AND c IS NOT NULL", "a IN (SELECT b FROM u WHERE c = 1)", "NOT EXISTS (SELECT 1 FROM u)", "a < b"],
)
def test_conditions(cond):
    assert S.parse(f"SELECT * FROM t WHERE {cond}").where is not None


def test_and_binds_tighter_than_or():
    e = S.parse("SELECT * FROM t WHERE a = 1 OR b = 2 AND c = 3").where
    assert e.op == "or" and e.right.op == "and"


def test_quotes_and_names():
    q = S.parse("SELECT `odd-name`.f AS x FROM `my-bucket`.s.c AS `odd-name` WHERE a = 'it''s' AND b = \"q\\\"q\"")
    assert q.source == S.Source("my-bucket", "s", "c", "odd-name")
    assert q.where.left.right.value == "it's" and q.where.right.right.value == 'q"q'


def test_joins():
    q = S.parse("SELECT * FROM a LEFT OUTER NEST b ON a.x = META(b).id LEFT UNNEST a.tags t JOIN c ON c.i = a.i")
    assert [(j.kind, j.left) for j in q.joins] == [("nest", True), ("unnest", True), ("join", False)]


def test_index_statements():
    s = S.parse("CREATE INDEX i ON b(x.y, DISTINCT ARRAY v FOR v IN tags END) INCLUDE (z) WHERE k = 'a'")
    assert s.keys[1].array and s.keys[1].distinct and s.include[0].parts == ("z",)
    assert S.parse("DROP INDEX b.i") == S.parse("DROP INDEX i ON b")
    assert S.parse("CREATE PRIMARY INDEX ON b").primary


def test_parameters_are_values_not_text():
    q = S.bind(S.parse("SELECT * FROM t WHERE a = $p LIMIT $1"), {"p": "x' OR 1=1", "1": 4})
    assert q.where.right.value == "x' OR 1=1" and q.limit == 4
    with pytest.raises(S.QueryError):
        S.bind(q.__class__(q.items, where=S.Param("none")), {})


@pytest.mark.parametrize("text", ["", "SELEC a", "SELECT a FROM", "SELECT a FROM t WHERE", "SELECT a FROM t extra words here", "UPDATE t WHERE a = 1", "SELECT a NOT b FROM t", "SELECT (a FROM t"])
def test_errors(text):
    with pytest.raises(S.QueryError):
        S.parse(text)
