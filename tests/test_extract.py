"""Literal DDL cases (FIXTURES.md §3) for the extractor."""

import pytest

from schemaloom.operators import extract as E


def one(spark, corpus_of, ddl):
    rows = E.definitions(corpus_of([("t", 1, ddl)])).collect()
    assert len(rows) == 1
    return rows[0]


def test_ctas_query_is_extracted(spark, corpus_of):
    r = one(spark, corpus_of, "CREATE TABLE d.t STORED AS ORC AS SELECT a FROM d.s")
    assert r.as_sql == "select a from d.s"
    assert r.options_tail == "stored as orc"


def test_if_not_exists_does_not_eat_names(spark, corpus_of):
    r = one(spark, corpus_of, "CREATE TABLE IF NOT EXISTS d.notes (a INT)")
    assert (r.ident_db, r.ident_tbl) == ("d", "notes")


def test_three_part_backquoted_name(spark, corpus_of):
    r = one(spark, corpus_of, "CREATE TABLE spark_catalog.`d1`.`a` (id INT)")
    assert (r.ident_db, r.ident_tbl) == ("d1", "a")
    assert [c.name for c in r.columns] == ["id"]


def test_view_is_classified_first(spark, corpus_of):
    r = one(spark, corpus_of, "CREATE VIEW d.v AS SELECT 1")
    assert r.shape == "view" and r.ident_tbl == "v"
    assert r.view_text == "create view d.v as select 1"
    assert r.reject_reason is None


def test_like_word_in_comment_is_not_like(spark, corpus_of):
    r = one(spark, corpus_of, "CREATE TABLE d.t (a INT COMMENT 'like this')")
    assert r.shape == "table" and r.columns[0].comment == "like this"


def test_like_table(spark, corpus_of):
    r = one(spark, corpus_of, "CREATE TABLE d.t LIKE d.s LOCATION '/x'")
    assert r.shape == "like" and r.like_table == "d.s"
    assert r.options_tail == "location '/x'"


def test_no_space_before_paren(spark, corpus_of):
    r = one(spark, corpus_of, "CREATE TABLE d.t(a INT)")
    assert len(r.columns) == 1


def test_comment_kept_whole(spark, corpus_of):
    r = one(spark, corpus_of, "CREATE TABLE d.t (a INT COMMENT 'x, (y) z', b STRING)")
    assert [(c.name, c.type, c.comment) for c in r.columns] == [
        ("a", "INT", "x, (y) z"), ("b", "STRING", None)]


def test_constraint_only_when_item_starts_with_keyword(spark, corpus_of):
    r = one(spark, corpus_of,
            "CREATE TABLE d.t (a INT COMMENT 'primary key of s', "
            "CONSTRAINT pk PRIMARY KEY (a) DISABLE NOVALIDATE)")
    assert [c.name for c in r.columns] == ["a"]
    assert r.constraints == ["constraint pk primary key (a) disable novalidate"]


def test_tail_keyword_inside_comment_ignored(spark, corpus_of):
    r = one(spark, corpus_of, "CREATE TABLE d.t (a INT COMMENT 'its location') STORED AS ORC")
    assert r.options_tail == "stored as orc"


def test_nested_types_stay_whole(spark, corpus_of):
    r = one(spark, corpus_of,
            "CREATE TABLE d.t (m MAP<STRING,STRUCT<a:DECIMAL(10, 2),b:ARRAY<INT>>>, n INT)")
    assert [(c.name, c.type) for c in r.columns] == [
        ("m", "MAP<STRING,STRUCT<A:DECIMAL(10,2),B:ARRAY<INT>>>"), ("n", "INT")]


def test_untyped_partition_column(spark, corpus_of):
    r = one(spark, corpus_of, "CREATE TABLE d.t (a INT, dt STRING) USING parquet PARTITIONED BY (dt)")
    assert [(c.name, c.type) for c in r.part_columns] == [("dt", None)]
    assert r.provider == "parquet"


def test_duplicate_column_first_wins(spark, corpus_of):
    r = one(spark, corpus_of, "CREATE TABLE d.t (a INT, a STRING)")
    assert [(c.name, c.type, c.pos) for c in r.columns] == [("a", "INT", 1)]


def test_clauses(spark, corpus_of):
    r = one(spark, corpus_of,
            "create external table d.t (a int, b int)\nPARTITIONED BY (dt STRING COMMENT 'day')\n"
            "CLUSTERED BY (a) SORTED BY (b) INTO 8 BUCKETS\n"
            "SKEWED BY (a) ON ((1),(2)) STORED AS DIRECTORIES\n"
            "ROW FORMAT DELIMITED STORED AS TEXTFILE LOCATION '/Data/T'")
    assert r.kind == "external"
    assert r.clustered == "clustered by (a) sorted by (b) into 8 buckets"
    assert r.n_buckets == 8 and r.cluster_cols == "a"
    assert (r.skewed, r.skewed_on, r.skewed_dirs) == (
        "skewed by (a)", "on ((1),(2))", "stored as directories")
    assert r.options_tail == "row format delimited stored as textfile location '/Data/T'"
    assert [(c.name, c.comment) for c in r.part_columns] == [("dt", "day")]


def test_wide_table(spark, corpus_of):
    n = 10_000
    ddl = "CREATE TABLE d.w (" + ", ".join(f"c{i} DECIMAL(10,2) COMMENT 'x, y'" for i in range(n)) + ")"
    out = E.def_columns(E.definitions(corpus_of([("w", 1, ddl)])))
    assert out.count() == n


@pytest.mark.parametrize("ddl,reason", [
    ("CREATE TABLE d.t (a INT, b ((INT)", "column list unbalanced"),
    ("CREATE TABLE d.t (a INT) PARTITIONED BY (p INT", "partition list unbalanced"),
    ("CREATE TABLE d.t (a 'x' INT)", "column item that is not a name and a type"),
    ("SELECT 1", "not a CREATE TABLE or CREATE VIEW text"),
])
def test_rejected_rows_are_kept(spark, corpus_of, ddl, reason):
    rej = E.rejected(E.definitions(corpus_of([("t", 1, ddl)]))).collect()
    assert [r.reject_reason for r in rej] == [reason]


def test_columns_named_like_constraints(spark, corpus_of):
    r = one(spark, corpus_of, "CREATE TABLE d.t (check STRING, unique INT, primary DATE, constraint INT, "
                              "CHECK (a > 0), UNIQUE (a), CONSTRAINT c CHECK (b > 0))")
    assert [c.name for c in r.columns] == ["check", "constraint", "primary", "unique"]
    assert sorted(r.constraints) == ["check (a > 0)", "constraint c check (b > 0)", "unique (a)"]
    assert r.reject_reason is None


def test_names_of_many_parts(spark, corpus_of):
    r = one(spark, corpus_of, "CREATE TABLE a.b.c.u (id INT)")
    assert r.identity == "c.u" and [c.name for c in r.columns] == ["id"] and r.reject_reason is None


@pytest.mark.parametrize("ddl", ["CREATE TABLE d.u SHALLOW CLONE d.s", "CREATE TABLE d.u (a INT) NONSENSE x",
                                 "CREATE TABLE d.u x (a INT)"])
def test_unread_text_is_rejected(spark, corpus_of, ddl):
    assert one(spark, corpus_of, ddl).reject_reason == (
        "text after the name or the column list that was not read")


def test_function_items_are_partition_transforms_only(spark, corpus_of):
    r = one(spark, corpus_of, "CREATE TABLE d.t (a INT) PARTITIONED BY (days(ts), bucket( 16 , `id` ), dt)")
    assert [c.name for c in r.part_columns] == ["bucket(16,id)", "days(ts)", "dt"]
    assert r.reject_reason is None
    assert one(spark, corpus_of, "CREATE TABLE d.t (days(ts))").reject_reason


def test_sql_comments_and_struct_comments(spark, corpus_of):
    r = one(spark, corpus_of, "/* x */ CREATE TABLE d.t ( -- it's, (open\n a STRUCT<x: INT COMMENT 'Q, >', "
                              "`y z`: MAP<STRING, INT>> COMMENT 'c -- d', /* b INT, */ e INT) -- end")
    assert [(c.name, c.type, c.comment) for c in r.columns] == [
        ("a", "STRUCT<X:INT COMMENT 'Q, >',`y z`:MAP<STRING,INT>>", "c -- d"), ("e", "INT", None)]
    assert r.reject_reason is None
    deep = "INT COMMENT 'In (x'"
    for i in range(8):
        deep = f"STRUCT<f{i}: {deep}>"
    r = one(spark, corpus_of, f"CREATE TABLE d.t (s {deep}, b INT)")
    assert r.reject_reason is None and "INT COMMENT 'In (x'" in r.columns[1].type


def test_any_depth_and_quotes(spark, corpus_of):
    deep = "INT"
    for i in range(9):
        deep = f"STRUCT<f{i}: {deep}, g: MAP<STRING,DECIMAL(10,2)>>"
    defs = {r.v: r for r in E.definitions(corpus_of([
        ("t", 1, "CREATE TABLE d.t (id INT, k INT, CHECK (((id > 0) AND (((k < 5))))), z INT) STORED AS ORC"),
        ("t", 2, f"CREATE TABLE d.t (id INT, s {deep} COMMENT 'a, (b', e ARRAY<INT>) "
                 "PARTITIONED BY (dt STRING)"),
        ("t", 3, "CREATE TABLE d.t (a STRING COMMENT 'it''s', b INT DEFAULT 5, c STRING NOT NULL "
                 "DEFAULT concat('x', (('y'))) COMMENT \"say \"\"hi\"\"\", e STRING COLLATE utf8_lcase, "
                 "g INT GENERATED ALWAYS AS (((b + (1)))) COMMENT 'gen')"),
        ("t", 4, "CREATE TABLE d.t (a INT, b ((INT)"),
        ("t", 5, "CREATE TABLE d.t (a 'odd' INT)"),
        ("t", 7, "CREATE TABLE d.t (a INT CHECK (((a > 0))) COMMENT 'c', b INT PRIMARY KEY ENABLE)"),
        ("t", 6, "CREATE TABLE d.t (a INT) SKEWED BY (a) ON (((1)),((2))) STORED AS ORC")])).collect()}
    assert [c.name for c in defs[1].columns] == ["id", "k", "z"] and defs[1].reject_reason is None
    assert defs[1].constraints == ["check (((id > 0) and (((k < 5)))))"]
    assert defs[1].options_tail == "stored as orc"
    cols = {c.name: c for c in defs[2].columns}
    assert cols["s"].type == deep.upper().replace(", ", ",").replace(": ", ":")
    assert cols["s"].comment == "a, (b" and cols["e"].type == "ARRAY<INT>"
    assert [c.name for c in defs[2].part_columns] == ["dt"] and defs[2].reject_reason is None
    got = [(c.name, c.type, c.comment) for c in defs[3].columns]
    assert got == [("a", "STRING", "it's"), ("b", "INT", None), ("c", "STRING", 'say "hi"'),
                   ("e", "STRING", None), ("g", "INT", "gen")]
    assert defs[3].reject_reason is None
    assert defs[4].reject_reason and defs[5].reject_reason
    assert [(c.name, c.type, c.comment) for c in defs[7].columns] == [
        ("a", "INT", "c"), ("b", "INT", None)]
    assert defs[6].skewed_on == "on (((1)),((2)))"


def test_diff_over_unreadable_versions(spark, corpus_of, monkeypatch):
    """The version after unreadable ones is compared with the last readable
    one, also where runs of version numbers end between the two."""
    from schemaloom.operators import diff as D
    from schemaloom.operators import history as H
    bad = "CREATE TABLE d.t (a INT, b ((INT)"
    rows = [("t", 1, "CREATE TABLE d.t (a INT, b INT)"), ("t", 2, bad), ("t", 3, "CREATE TABLE d.t (a INT)"),
            ("t", 4, "CREATE TABLE d.t (a BIGINT)"), ("t", 5, bad), ("t", 6, bad), ("t", 7, bad),
            ("t", 8, "CREATE TABLE d.t (z STRING)"), ("t", 9, bad), ("t", 10, "CREATE TABLE d.t (z STRING)"),
            ("u", 1, bad), ("u", 2, "CREATE TABLE d.u (a INT)"), ("w", 5, "CREATE TABLE d.w (a INT)")]
    for at_once in (1024, 1, 2, 3):
        monkeypatch.setattr(D, "VERSIONS_AT_ONCE", at_once)
        monkeypatch.setattr(H, "VERSIONS_AT_ONCE", at_once)
        defs = E.definitions(corpus_of(rows))
        assert sorted((r.v, r.name, r.change) for r in D.diff_columns(defs).collect()
                      if r.change != "same") == [
            (3, "b", "deleted"), (4, "a", "changed"), (8, "a", "deleted"), (8, "z", "added")]
        assert sorted((r.tbl, r.v, r.v_prev) for r in D.version_pairs(defs).collect()) == [
            ("t", 3, 1), ("t", 4, 3), ("t", 8, 4), ("t", 10, 8)]
        assert sorted((r.tbl, r.v) for r in H.distinct_versions(defs).collect()) == [
            ("t", 1), ("t", 3), ("t", 4), ("t", 8), ("u", 2), ("w", 5)]
        assert sorted(r.v for r in E.rejected(defs).collect()) == [1, 2, 5, 6, 7, 9]
