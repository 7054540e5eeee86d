"""Migration safety."""

import uuid

import pytest

from schemaloom.operators import migrate as M


@pytest.fixture
def db(spark):
    name = f"mig_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {name}")
    return name


def live(spark, db, n=1000):
    t = f"{db}.src"
    spark.range(n).selectExpr("id", "cast(id % 7 as int) as k", "cast(id as string) as s") \
        .write.saveAsTable(t)
    return t


def test_with_name_splices_name_and_drops_location():
    ddl = "CREATE TABLE IF NOT EXISTS Db.MyTab (a INT COMMENT 'location x') LOCATION '/data/x'"
    out = M.with_name(ddl, "s.t2")
    assert out.startswith("CREATE TABLE IF NOT EXISTS `s`.`t2` (a INT COMMENT 'location x')")
    assert "/data/x" not in out


def test_bad_definition_leaves_table_untouched(spark, db):
    t = live(spark, db)
    r = M.migrate_table(spark, t, f"CREATE TABLE {t} (id BIGINT, x NOSUCHTYPE) USING parquet",
                        f"SELECT id FROM {t}", scratch_db=db)
    assert r.status == "bad_definition" and r.stage == "check"
    assert spark.table(t).count() == 1000


def test_full_migration(spark, db):
    t = live(spark, db)
    r = M.migrate_table(spark, t, f"CREATE TABLE {t} (id BIGINT, k BIGINT, s2 STRING) USING parquet",
                        f"SELECT id, k, concat(s, '!') AS s2 FROM {t}", scratch_db=db)
    assert (r.status, r.n_source, r.n_backup, r.n_new) == ("ok", 1000, 1000, 1000)
    assert spark.table(t).columns == ["id", "k", "s2"]
    assert spark.table(t).filter("s2 = '5!'").count() == 1
    assert not any(M.working_tables(spark, t).values())


def test_filtering_select_is_verified_against_itself(spark, db):
    t = live(spark, db)
    r = M.migrate_table(spark, t, f"CREATE TABLE {t} (id BIGINT) USING parquet",
                        f"SELECT id FROM {t} WHERE id < 10", scratch_db=db)
    assert (r.status, r.n_source, r.n_new) == ("ok", 1000, 10)
    assert spark.table(t).count() == 10


def test_wrong_values_are_a_load_mismatch(spark, db):
    t = live(spark, db)
    r = M.migrate_table(spark, t, f"CREATE TABLE {t} (id DOUBLE) USING parquet",
                        f"SELECT id + rand() AS id FROM {t}", scratch_db=db)
    assert r.status == "load_mismatch" and "missing" in r.error
    assert spark.table(t).count() == 1000 and "k" in spark.table(t).columns
    assert not any(M.working_tables(spark, t).values())


@pytest.mark.parametrize("where", ["", "/..", "/sub"])
def test_shared_location_is_refused(spark, db, tmp_path, where):
    t, folder = f"{db}.loc", tmp_path / "a" / "b"
    spark.range(100).write.option("path", f"file://{folder}").saveAsTable(t)
    r = M.migrate_table(spark, t, f"CREATE TABLE {t} (id BIGINT) USING parquet LOCATION '{folder}{where}'",
                        f"SELECT id FROM {t}", scratch_db=db)
    assert r.status == "shared_location" and spark.table(t).count() == 100


def test_location_of_another_source_is_refused(spark, db, tmp_path):
    t, other = live(spark, db), f"{db}.other"
    spark.range(5).write.option("path", f"file://{tmp_path}/o").saveAsTable(other)
    r = M.migrate_table(spark, t, f"CREATE TABLE {t} (id BIGINT) USING parquet LOCATION '{tmp_path}/o'",
                        f"SELECT a.id FROM {t} a JOIN {other} b ON a.id = b.id", scratch_db=db)
    assert r.status == "shared_location" and spark.table(other).count() == 5


def test_extra_select_column_is_refused(spark, db):
    t = live(spark, db)
    r = M.migrate_table(spark, t, f"CREATE TABLE {t} (id BIGINT, k INT) USING parquet",
                        f"SELECT id, k, s FROM {t}", scratch_db=db)
    assert r.status == "failed" and r.stage == "load" and "'s'" in r.error
    assert spark.table(t).count() == 1000


def test_saved_definition_is_checked(spark, db):
    t = live(spark, db)
    r = M.migrate_table(spark, t, f"CREATE TABLE {t} (id BIGINT) USING parquet", f"SELECT id FROM {t}",
                        scratch_db=db, saved_ddl=f"CREATE TABLE {t} (id NOSUCH) USING parquet")
    assert r.status == "bad_saved_definition" and len(r.error) > 20


class Kill(BaseException):
    pass


@pytest.mark.parametrize("at", M.STAGES[:-1])
def test_rerun_after_a_kill(spark, db, at):
    t = live(spark, db, 50)
    args = (spark, t, f"CREATE TABLE {t} (id BIGINT) USING parquet", f"SELECT id FROM {t}", db)

    def stop(stage):
        if stage == at:
            raise Kill
    with pytest.raises(Kill):
        M.migrate_table(*args, on_stage=stop, lease_seconds=0 if at != "load" else 60)
    assert spark.table(t).count() == 50
    if at == "load":  # the dead run's lease has not run out
        assert M.journal(spark, t)["stage"] == "load" and "at.backup" in M.journal(spark, t)
        assert M.recover(spark, t) == "held" and any(M.working_tables(spark, t).values())
        r = M.migrate_table(*args)
        assert r.status == "refused" and "at stage load" in r.error
        assert M.recover(spark, t, break_lease=True) == "removed"
    r = M.migrate_table(*args)
    assert r.status == "ok" and spark.table(t).columns == ["id"] and spark.table(t).count() == 50
    assert not any(M.working_tables(spark, t).values())


def test_kill_between_the_renames(spark, db):
    t = live(spark, db, 50)
    spark.sql(f"ALTER TABLE {t} RENAME TO {t}__sl_old_0123abcd")
    assert M.recover(spark, t) == "undone"
    assert spark.table(t).count() == 50 and M.recover(spark, t) == "clean"


def test_external_goes_with_its_location():
    out = M.with_name("CREATE EXTERNAL TABLE a.b (x INT) STORED AS ORC LOCATION '/d'", "s.t")
    assert out.startswith("CREATE TABLE `s`.`t` (x INT)") and "LOCATION" not in out


def test_maps_compare_by_entries(spark):
    a = spark.sql("SELECT map('a', 1, 'b', 2) AS m, array(named_struct('x', map(1, 2, 3, 4))) AS n")
    b = spark.sql("SELECT map('b', 2, 'a', 1) AS m, array(named_struct('x', map(3, 4, 1, 2))) AS n")
    assert tuple(M.reconcile_content(a, b).first()) == (0, 0)
    assert M.reconcile_fingerprint(a, b).first().equal


def test_reconcile_content_counts_copies(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a int, b string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "a int, b string")
    r = M.reconcile_content(a, b).first()
    assert (r.n_missing, r.n_extra) == (1, 1)
    assert M.reconcile_fingerprint(a, a).first().equal
    assert not M.reconcile_fingerprint(a, b).first().equal


def test_late_rows_are_loaded_and_a_second_run_is_refused(spark, db):
    """Rows come in during the load, the verification and right before the
    renames, and one goes; meanwhile another run is refused."""
    t = live(spark, db, 200)
    args = (spark, t, f"CREATE TABLE {t} (id BIGINT, n BIGINT) USING parquet",
            f"SELECT id, count(*) AS n FROM {t} GROUP BY id", db)
    seen = []

    def arrive(stage):
        if stage in ("load", "verify", "swap"):
            k = 1000 + len(seen)
            spark.sql(f"INSERT INTO {t} VALUES ({k}, 0, 'late'), ({k}, 0, 'late'), (1, 0, 'again')")
            seen.append(M.migrate_table(*args).status)
    r = M.migrate_table(*args, on_stage=arrive)
    assert r.status == "ok" and seen == ["refused"] * 3
    got = {x.id: x.n for x in spark.table(t).collect()}
    assert len(got) == 203 and got[1000] == got[1001] == got[1002] == 2 and got[1] == 4 and got[2] == 1
    assert not any(M.working_tables(spark, t).values()) and M.journal(spark, t) == {}


def test_an_expired_lease_is_taken_once(spark, db):
    t = live(spark, db, 5)
    assert M.take_lease(spark, t, "aaaa", 0)["run"] == "aaaa"
    assert M.take_lease(spark, t, "bbbb", 60)["run"] == "bbbb"
    assert M.take_lease(spark, t, "cccc", 60)["run"] == "bbbb"
    M._drop_lease(spark, t, "aaaa")  # not its own any more
    assert M.journal(spark, t)["run"] == "bbbb"


def test_only_leaves_that_differ_are_compared(spark):
    a = spark.range(20_000).selectExpr("id", "id % 7 AS k", "map('a', id) AS m")
    b = a.where("id <> 5").unionByName(a.where("id = 9")).selectExpr(
        "id", "if(id = 77, 100, k) AS k", "m")
    tree = M.hash_tree(a, b).collect()
    assert {x.level for x in tree} == set(range(M.TREE_LEVELS + 1))
    assert sum(x.level == 0 for x in tree) == 1 and sum(x.level == M.TREE_LEVELS for x in tree) == 4
    assert M.rows_apart(a, b).count() < 30  # of 40,000
    assert M.rows_apart(a, a).count() == 0 and M.hash_tree(a, a).count() == 0
    assert tuple(M.reconcile_content(a, b).first()) == (2, 2)
    assert sorted(x.id for x in M.rows_missing(a, b).collect()) == [5, 77]
    assert [x.id for x in M.rows_missing(b, a).collect() if x.id != 77] == [9]
    df = M.reconcile_content(a, b)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    rows = plan[plan.index("Exchange hashpartitioning(id"):]
    assert "BroadcastHashJoin" in rows and "LeftSemi" in rows  # below the shuffle of rows


def test_sources_behind_views_and_subqueries(spark, db, tmp_path):
    t, v = live(spark, db, 5), f"{db}.v"
    spark.sql(f"CREATE TABLE {db}.o AS SELECT 1 AS x")
    spark.range(3).write.parquet(f"{tmp_path}/p")
    spark.sql(f"CREATE VIEW {v} AS SELECT id FROM {t}")
    got = M.sources_read(spark, f"WITH c AS (SELECT * FROM {v}) SELECT id FROM c WHERE id IN "
                                f"(SELECT x FROM {db}.o) UNION ALL SELECT id FROM parquet.`{tmp_path}/p`")
    assert {k.rpartition(".")[2] for k in got if db in k} == {"src", "o"}
    assert any(k.endswith("/p") for k in got) and all(got.values())
