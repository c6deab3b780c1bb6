"""What lets the queries over code run on large tables: facts of templates, narrow rows, plans without detours."""

import random

import pytest
from oddlines import queries
from oddlines.operators import features, parse

SF = "/root/testdata/sf0.001"
SHAPED = 'class A:\n    def f(self, x=%d):\n        if x > %d and self.y[%d] != "a %d":\n            return helper(x, len(self.y), %d)\n        for i in (x, %d): self.z = 1e-%d + i\n\n\ndef helper(a, b, c):\n    return a + b * %d\n'


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plain(row):
    return {k: [[list(y) if isinstance(y, tuple | list) else y for y in x] for x in v] if isinstance(v, list) else v for k, v in row.items()}


@pytest.mark.parametrize("wanted", [parse.WANTED, ("lines",), ("bodies",), ("spans", "structures", "labels"), ()])
def test_files_that_differ_in_numbers_have_their_own_facts(wanted):
    draw, parser = random.Random(1), parse.Parser(wanted)
    codes = [SHAPED % tuple(draw.choice((1, 5, 7, 12, 40_000)) for _ in range(8)) for _ in range(50)] + [f"x = ({k}\n" for k in range(9)] + ["a\\\n = 5\n", "a\\\n = 6\n", "x = 007 + 5\n", "x = 007 + 6\n"] * 2
    for code in codes:
        assert plain(parser.parse("f", code)) == plain(parse.parse_one("f", code, wanted))


def test_files_that_differ_in_numbers_are_parsed_twice_at_most(monkeypatch):
    seen = []
    monkeypatch.setattr(parse.ast, "parse", lambda code, own=parse.ast.parse: seen.append(code) or own(code))
    parser = parse.Parser(("lines",))
    for k in range(1, 100):
        assert parser.parse("f", f"if part1 > {k}:\n    x = {k + 1}\n")["lines"][0][1] == f"if part1 > {k}:"
    assert len(seen) == 2


def test_templates_are_bounded():
    parser = parse.Parser(("lines",), held_chars=100)
    for k in range(500):
        parser.parse("f", f"name_{k} = 1\n")
    assert sum(map(len, parser.known)) <= 120


@pytest.mark.parametrize("line", ["x.y(a[1], {b: 2}) // 3 <<= 4", "if part1 > 123:", "1.5 + .5 + 0x1f + 1_0", "x = 'a # b' # c", "f(a, b", "a)", "x <> y", "012", "a..b", "é = ~b", "x if y else -z ** 2 -> 3", "a" * 5000 + "'"])
def test_simple_lines_have_the_tokens_of_the_library(line, monkeypatch):
    quick = parse.tokens(line)
    monkeypatch.setattr(parse, "_SIMPLE", lambda raw: None)
    assert quick == parse.tokens(line)


def test_function_features_write_nothing(spark):
    assert "FileScan parquet" in plan(found := queries.code_function_features(spark, SF)) and "/lineitem.parquet" in plan(found) and "MapInArrow" in plan(found)


def test_line_features_need_no_lambdas(spark):
    found = plan(queries.code_line_features(spark, SF))
    assert "/lineitem.parquet" in found and found.split("MapInArrow")[0].count("lambda") == 0


def test_lineage_labels_come_with_the_tree(spark):
    assert "ArrowEvalPython" not in plan(queries.code_lineage(spark, SF))


def test_labels_with_the_tree_equal_later_ones(spark):
    code = "async def f(x):\n    for a, *b in x:\n        while (y := g(\n                a)):\n            if y: pass\n    async with z: pass\n    try: pass\n    except (A, B[1]): pass\n    except: pass\n    match x:\n        case 1: pass\n"
    early, late = parse.parse_one("f", code, ("spans", "structures", "labels")), parse.parse_one("f", code, ("spans", "structures"))
    assert [x[5] for x in early["structures"]] == [parse.label(x[0], x[1], x[4]) for x in late["structures"]] and len(early["structures"]) == 9


def test_linear_scores_need_no_lambdas(spark):
    assert "lambda" not in plan(queries.code_linear_scores(spark, SF)).split("MapInArrow")[0]


def test_checks_walk_no_tree(monkeypatch):
    monkeypatch.setattr(parse, "tree_facts", None)
    assert parse.parse_one("f", "x = 1\n", ())["parse_ok"] and not parse.parse_one("f", "x = (\n", ())["parse_ok"]
    assert parse.parse_one("f", "-" * 200_000 + "1", ())["error"].startswith(("RecursionError", "MemoryError"))


def test_first_that_parses_looks_no_further(spark):
    rows = spark.createDataFrame([(1, "x = 1\n", "y = 2\n"), (2, "x = (", "x = 1\n"), (3, "x = (", "x = ("), (4, None, "x")], "id int, a string, b string")
    got = {r["id"]: (r["a_parses"], r["b_parses"]) for r in parse.first_that_parses(rows, ("a", "b")).collect()}
    assert got == {1: (True, None), 2: (False, True), 3: (False, False), 4: (True, None)}


def test_repaired_code_groups_once(spark):
    assert plan(queries.repaired_code(spark, SF)).split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_class_function_features_need_no_lambdas(spark):
    assert "lambda" not in plan(queries.class_function_features(spark, SF)).split("MapInArrow")[0]


def test_call_depths_come_with_functions():
    depths = {f[1]: f[8] for f in parse.parse_one("f", "def a(): b()\ndef b(): x.c()\ndef c(): d(); a()\ndef d(): e()\ndef e(): f()\ndef f(): f()\n", ("lines",))["functions"]}
    assert depths == {"a": 4, "b": 4, "c": 3, "d": 2, "e": 1, "f": 0}


def test_class_line_features_need_no_lambdas(spark):
    assert "lambda" not in plan(queries.class_line_features(spark, SF)).split("MapInArrow")[0]


def test_class_lineage_labels_come_with_the_tree(spark):
    assert "ArrowEvalPython" not in plan(queries.class_lineage(spark, SF))


def test_review_joins_both_sides_once_and_keeps_no_features(spark, monkeypatch):
    from oddlines.plans import review

    kept, plans, own = {}, {}, review.written

    def written(df, label):
        kept[label], plans[label] = df.columns, plan(df)
        return own(df, label)

    monkeypatch.setattr(review, "written", written)
    queries.pr_reports(spark, SF)
    assert "review-parsed" not in kept and "token_entropy" not in kept["review-scored"] and "score" in kept["review-scored"]
    assert plans["review-scored"].split("Initial Plan")[-1].count("Join") == 1


def test_chains_of_nested_spans():
    assert parse.chains([(0, 1, 9), (1, 2, 5), (2, 2, 4), (3, 3, 4), (4, 4, 4), (5, 7, 7)], 10)[1:] == [[0], [1, 0], [3, 1, 0], [4, 3, 1], [1, 0], [0], [5, 0], [0], [0], []]


def test_comments_keep_lineages_of_flagged_lines_only(spark, monkeypatch):
    from oddlines.plans import review

    kept, own = {}, review.written
    monkeypatch.setattr(review, "written", lambda df, label: kept.setdefault(label, own(df, label)))
    queries.pr_comments(spark, SF)
    assert kept["review-scored"].filter("lineage IS NOT NULL AND NOT (flag AND side = 'head')").count() == 0
    assert kept["review-scored"].filter("flag AND side = 'head' AND lineage IS NULL").count() == 0


def test_submissions_are_parsed_without_bodies(spark, monkeypatch):
    from oddlines.streaming import jobs

    kept, own = {}, jobs.written
    monkeypatch.setattr(jobs, "written", lambda df, label: kept.setdefault(label, own(df, label)))
    batch = spark.createDataFrame([("1", "python", "def f(x):\n    return x\n")], "file_id string, language string, code string")
    analyses, refused = jobs.answer_submissions(batch)
    assert kept["submissions"].selectExpr("size(bodies) AS n", "size(lines) AS m").first() == (0, 2)
    assert analyses.count() == 1 and refused.count() == 0
