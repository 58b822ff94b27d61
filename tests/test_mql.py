import pytest
from lorebank.plans import mql
from lorebank.plans.mql import parser as ast
from lorebank.plans.mql.executor import micros
from lorebank.plans.mql.lexer import tokenize

U1, U2 = "550e8400-e29b-41d4-a716-446655440000", "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def test_tokens():
    kinds = [(t.kind, t.text) for t in tokenize(f'recall NEAR [1, -0.5] where tag ~> "a \\" b" {U1} -> x-y >= 3')]
    assert kinds == [
        ("keyword", "RECALL"), ("keyword", "NEAR"), ("punct", "["), ("int", "1"), ("punct", ","), ("float", "-0.5"), ("punct", "]"), ("keyword", "WHERE"), ("word", "tag"), ("op", "~>"), ("string", 'a \\" b'),
        ("uuid", U1), ("arrow", "->"), ("word", "x-y"), ("op", ">="), ("int", "3"), ("end", ""),
    ]


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("RECALL memories", "full_scan"),
        ("RECALL memories NEAR [0.1, 0.2] LIMIT 5", "vector_search"),
        ("RECALL NEAR [0.1] WHERE type = episodic AND tag = x LIMIT 5", "vector_search"),
        ('RECALL memories WHERE content ~> "database" LIMIT 3', "similar_text"),
        ("RECALL WHERE tag = a AND tag = b", "tag_scan"),
        ("RECALL WHERE created > 5 AND salience > 0.1", "time_scan"),
        ("RECALL WHERE salience > 0.1 ORDER BY created", "full_scan"),
        (f"RELATE {U1} -> {U2} AS caused", "edge_insert"),
        (f"FORGET {U1}", "delete"),
        (f'FORGET "{U1}"', "delete"),
        ("CONSOLIDATE WHERE confidence > 0.5", "consolidate"),
        (f"TRAVERSE {U1} DEPTH 3 WHERE edge_type = part_of", "traversal"),
    ],
)
def test_plan_kinds(text, kind):
    assert mql.plan(mql.parse(text)).kind == kind


def test_statements():
    s = mql.parse("RECALL memories NEAR [1, 2.5] WHERE type = anti_pattern AND agent = \"x\" AND salience >= 0.5 ORDER BY created DESC LIMIT 7")
    assert s == ast.Recall([1.0, 2.5], [ast.Filter("type", "=", "AntiPattern"), ast.Filter("agent", "=", "x"), ast.Filter("salience", ">=", 0.5)], "created", True, 7)
    assert mql.parse(f"RELATE {U1} -> {U2} AS supersedes WITH weight = 0.9") == ast.Relate(U1, U2, "Supersedes", 0.9)
    assert mql.parse(f"TRAVERSE {U1} DEPTH 2") == ast.Traverse(U1, 2, None)
    assert mql.parse("CONSOLIDATE") == ast.Consolidate([])
    assert mql.plan(mql.parse("RECALL")).limit == 20
    assert mql.parse("RECALL NEAR []").near == []


@pytest.mark.parametrize(
    "text",
    ["", "SELECT 1", "RECALL LIMIT", "RECALL LIMIT -1", "RECALL WHERE color = 1", "RECALL WHERE type = dream", "RECALL WHERE tag = a OR tag = b", "RECALL WHERE NOT tag = a", "RECALL memories x", "RECALL WHERE content ~> 5", "RECALL WHERE salience ~> \"x\"",
     f"RELATE {U1} {U2}", f"RELATE {U1} -> {U2} AS loves", "FORGET", f"TRAVERSE {U1}", "RECALL NEAR [1 2]", "RECALL # 5", f"TRAVERSE {U1} DEPTH 2 WITHIN 3"],
)
def test_errors(text):
    with pytest.raises(mql.MqlError):
        mql.parse(text)


def test_times():
    assert micros("1970-01-02") == 86_400_000_000 and micros("1970-01-01T00:00:01+01:00") == -3_599_000_000 and micros(5) == 5
    with pytest.raises(mql.MqlError):
        micros("yesterday")
