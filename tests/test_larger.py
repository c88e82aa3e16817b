"""Keys and values that the test tables are too small to have, against the queries' SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from waylark.plans import catalog

from test_queries import DATA, TABLES, plain


def held(spark, tmp_path, name, **tables):
    """The rows of a query and of its SQL over the test tables, some of them replaced by columns of values."""
    con = duckdb.connect()
    for t in TABLES:
        here = tmp_path / f"{t}.parquet"
        if t in tables:
            of = pq.read_schema(f"{DATA}/{t}.parquet")
            n = len(next(iter(tables[t].values())))
            pq.write_table(pa.table([pa.array(tables[t].get(f.name, [None] * n), f.type) for f in of], schema=of), here)
        else:
            here.symlink_to(f"{DATA}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{here}'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    sql = con.execute(catalog.ORACLE[name])
    at = [[c[0] for c in sql.description].index(c) for c in columns]
    return sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()), sorted(tuple(plain(r[i]) for i in at) for r in sql.fetchall())


def test_the_last_fix_where_parts_have_seven_digits(spark, tmp_path):
    lines = {"l_orderkey": [1, 1, 2, 2, 3], "l_linenumber": [1, 2, 1, 2, 1], "l_partkey": [1999999, 1, 1999949, 2, 3], "l_suppkey": [1, 1, 1, 1, 1]}
    found, expected = held(spark, tmp_path, "final_common_fix", lineitem=lines)
    assert found == expected == [("F49", "2")]


def same_names():
    """Orders of two customers whose procedures and runways have the same names."""
    return {"o_orderkey": [1, 2, 3, 4, 5], "o_custkey": [5, 106925, 5, 106925, 106925], "o_totalprice": [1000.5, 2000.25, 300.0, 4000.75, 5000.5]}


def test_records_of_branches_with_the_same_names(spark, tmp_path):
    found, expected = held(spark, tmp_path, "fixed_width_encode", orders=same_names())
    assert found == expected and len(found) == 5


def test_records_of_branches_with_the_same_names_are_read_apart(spark, tmp_path):
    found, expected = held(spark, tmp_path, "fixed_width_roundtrip", orders=same_names())
    assert found == expected and len(found) == 5


def test_bearings_of_radials_round_as_in_sql(spark, tmp_path):
    """Arcs have a point for each five degrees, so the last bit counts; math libraries still differ in few of them."""
    from pyspark.sql import functions as F

    from waylark.operators import features
    from waylark.plans import feature_plans as sql

    at = str(tmp_path / "radials.parquet")
    con = duckdb.connect()
    con.execute("create table g as select n * 10 - 118.82 as lon, n * 2 - 23.58 as lat, r::double as r, td::double as td from range(24) a(n), (select unnest(range(5, 361, 5)) as r), (select unnest([1, 6, 11, 16]) as td)")
    con.execute(f"copy (select *, {sql._brg('lon', 'lat', 'tx', 'ty')} as b from (select *, {sql._dx('lon', 'lat', 'r', 'td')} as tx, {sql._dy('lon', 'lat', 'r', 'td')} as ty from g)) to '{at}'")
    rows = spark.read.parquet(at).withColumn("p", F.struct("lon", "lat"))
    apart = F.ceil(features._bearing(F.col("p"), features._ahead(F.col("p"), F.col("r"), F.col("td"))) / 5) != F.ceil(F.col("b") / 5)
    assert rows.count() == 6912 and rows.where(apart).count() < 70


def test_long_procedures_are_folded_in_time_that_grows_with_their_length(spark):
    import time

    from pyspark.sql import functions as F

    from waylark.operators import geometry

    n = F.col("id")
    fix = (n % 3 != 1) & (n > 2)
    legs = spark.range(40000, numPartitions=4).select(F.lit(1).alias("p"), n.cast("int").alias("sequence"), F.lit("TF").alias("path_terminator"), F.when(fix, n % 90 / 1.0).alias("lon"), F.when(fix, n % 70 / 1.0).alias("lat"), (n % 360).cast("double").alias("course"), F.when(n % 5 > 0, 3.0).alias("nm"))
    began = time.time()
    got = geometry.fold_legs(legs, "p").orderBy("sequence").collect()
    assert time.time() - began < 25
    assert [r["status"] for r in got[:5]] == ["OPEN"] * 3 + ["EXACT", "EXACT_START"] and [r["from_lon"] for r in got[:5]] == [None] * 4 + [3.0]
    assert len(got) == 40000 and all(a["to_lon"] is None or (a["to_lon"], a["to_lat"]) == (b["from_lon"], b["from_lat"]) for a, b in zip(got, got[1:]))


def test_long_routes_are_not_gathered(spark):
    import random

    from pyspark.sql import functions as F

    from waylark.operators import graph

    assert "collect_list" not in catalog.QUERIES["route_legs"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    chance = random.Random(4)
    rows = [(r, i, chance.choice(["A", "B", "C", "", None]), chance.choice(["IF", "TF"])) for r in range(200) for i in range(chance.randrange(1, 15))]
    legs = spark.createDataFrame(rows, "r int, i int, fix string, path_terminator string")
    whole = legs.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("i", "fix", "path_terminator"))).alias("l"))
    expected = whole.select("r", F.posexplode(graph.visited_once(F.col("l"))).alias("at", "x")).select("r", F.col("at") + 1, "x.i").collect()
    assert sorted(map(tuple, graph.flown(legs, ["r"], ["i"]).select("r", "place", "i").collect())) == sorted(map(tuple, expected))


def test_plans_are_made_without_the_legs_of_records(spark):
    """Each package has the legs of many records, which only its parts need."""
    plan = lambda name: catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan()
    assert "collect_list" not in plan("render_plan").toString()


def test_legs_of_records_join_parts_after_all_windows(spark):
    text = catalog.QUERIES["render_parts"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("collect_list") == 1 and text.index("Window ") < text.index("collect_list")


def test_answers_are_typed_once(spark):
    text = catalog.QUERIES["normalized_answers"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in text.splitlines() if line.lstrip(" :+-").startswith("Filter")]
    assert filters and not any("variant" in line for line in filters)
