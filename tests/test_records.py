from pyspark.sql import functions as F

from waylark.operators import align, compare, graph, grouping, merge
from waylark.sources import arinc424, external, files
from waylark.streaming import microbatch

LINES = [
    "SSPAP WMKJWMDAROS1L2RW16  010         1        CA                     1600        + 01000     11000       VJB   WMD   DG   002062209",
    "SSPAP WMKJWMDAROS1L2RW16  010         2P                                  0020                                             002072209",
    "SSPAP WMKJWMDAROS1L2RW16  020         1    R   CRYVJB WM      2700    3500    D   + 06000                             DG   002082209",
    "SSPAP WMKJWMDAROS1L2RW16  020         2P                                  0090                                             002092209",
    "not a record",
    "SSPAP WMKJWMDAROS1L2RW16  040AROSOWMEA1EE      CF VJB WM      3320032633200220D   + 06000                             DG   002122209",
]


def legs(spark):
    text = spark.createDataFrame([("\r\n".join(LINES),)], "text string")
    return {r["sequence"]: r for r in arinc424.read_legs(text).collect()}


def test_fields_by_position(spark):
    found = legs(spark)
    assert set(found) == {"010", "020", "040"}
    a, b, c = found["010"], found["020"], found["040"]
    assert (a["path_terminator"], a["course_deg"], a["altitude_value"], a["altitude_sign"], a["distance_nm"], a["recommended_navaid"]) == ("CA", 160.0, 1000.0, "+", 2.0, "VJB")
    assert (b["turn_direction"], b["theta_deg"], b["course_deg"], b["distance_nm"]) == ("R", 270.0, 350.0, 9.0)
    assert (c["fix"], c["fix_section"], c["end_of_procedure"], c["theta_deg"], c["rho_nm"], c["course_deg"]) == ("AROSO", "EA", True, 332.0, 32.6, 332.0)
    assert a["procedure_type"] == "SID" and a["procedure_name"] == "AROS 1L"
    assert [x["continuation_type"] for x in a["extensions"]] == ["2P"]
    assert a["raw_record"].count("\n") == 1


def test_order_of_partitions_does_not_matter(spark):
    lines = spark.createDataFrame([(0, i, l.ljust(132)) for i, l in enumerate(LINES)], "source int, ordinal int, line string")
    one = arinc424.merge_continuations(arinc424.parse_records(lines.coalesce(1))).orderBy("sequence").collect()
    many = arinc424.merge_continuations(arinc424.parse_records(lines.repartition(5, "ordinal"))).orderBy("sequence").collect()
    assert one == many


def side(spark, rows):
    return spark.createDataFrame(rows, "branch string, fix string, path_terminator string, sequence string")


def test_alignment_over_other_sequence_numbers(spark):
    l = side(spark, [("A", "", "VA", "010"), ("A", "T6R11", "DF", "020"), ("A", "VAMOS", "TF", "030"), ("B", "X", "TF", "010")])
    r = side(spark, [("A", "", "VA", "010"), ("A", "T6R11", "DF", "020"), ("A", "VAMOS", "TF", "070"), ("C", "Y", "TF", "010")])
    out = [(x["branch"], x["left_sequence"], x["right_sequence"]) for x in align.align_sequences(l, r, ["branch"]).orderBy("branch", "position").collect()]
    assert out == [("A", "010", "010"), ("A", "020", "020"), ("A", "030", "070"), ("B", "010", None), ("C", None, "010")]


def test_pairs_go_before_gaps():
    assert align.needleman_wunsch([[-4.0]], 1, 1) == [(0, 0)]
    assert align.needleman_wunsch([[-5.0]], 1, 1) == [(None, 0), (0, None)]


def test_greedy_pairs_take_the_first_free_one(spark):
    l = spark.createDataFrame([(1, "TATEYAMA", 1), (1, "DRAKY", 2)], "g int, name string, n int")
    r = spark.createDataFrame([(1, "TATEY", 1), (1, "TATEY", 2), (1, "DRAKY", 3)], "g int, name string, n int")
    got = sorted((x["status"], x["left_name"] or "", x["right_name"] or "") for x in align.greedy_pairs(l, r, "g", "name", "n").collect())
    assert got == [("MATCHED", "DRAKY", "DRAKY"), ("MATCHED", "TATEYAMA", "TATEY"), ("MISSING", "", "TATEY")]


def test_visited_fixes_are_flown_once(spark):
    rows = [("VAMOS", "TF"), ("VAMOS", "IF"), ("TIARA", "TF"), ("TIARA", "TF"), ("VAMOS", "TF"), ("", "VA")]
    df = spark.createDataFrame([(rows,)], "legs array<struct<fix: string, path_terminator: string>>")
    kept = df.select(graph.visited_once(F.col("legs")).alias("k")).first()["k"]
    assert [(x["fix"], x["path_terminator"]) for x in kept] == [("VAMOS", "TF"), ("TIARA", "TF"), ("VAMOS", "TF"), ("", "VA")]


def test_prefix_join_takes_sub_pages_only(spark):
    items = spark.createDataFrame([(1, "AD 2-X-28")], "item int, item_no string")
    pages = spark.createDataFrame([(1, "AD 2-X-28"), (2, "AD 2-X-28-1"), (3, "AD 2-X-281"), (4, None)], "page int, no string")
    assert sorted(r["page"] for r in grouping.prefix_join(items, "item_no", pages, "no").collect()) == [1, 2]


def test_ranges_over_several_blocks(spark):
    files_ = spark.createDataFrame([("a", 1, 1500), ("b", 1501, 10)], "f string, start long, n long")
    pages = spark.createDataFrame([(1,), (999,), (1500,), (1501,), (1511,)], "p long")
    got = {r["p"]: r["f"] for r in grouping.pages_in_ranges(pages, "p", files_, "start", "n").collect()}
    assert got == {1: "a", 999: "a", 1500: "a", 1501: "b"}


def test_renormalised_over_what_is_there(spark):
    n = F.lit(None).cast("double")
    got = spark.range(1).select(compare.renormalised({"topology": F.lit(100.0), "sequence": n, "fields": F.lit(50.0)}).alias("a"), compare.renormalised({"topology": n, "sequence": n, "fields": n}).alias("b")).first()
    assert (got["a"], got["b"]) == (71.4, None)


def test_upsert_ignores_blanks(spark):
    b = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "id int, s string, v double")
    n = spark.createDataFrame([(2, "", 9.0), (3, "z", None)], "id int, s string, v double")
    assert sorted(map(tuple, merge.upsert(b, n, "id").collect())) == [(1, "x", 1.0), (2, "y", 9.0), (3, "z", None)]


def test_replay_never_makes_up_success(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "input_hash string")
    known = spark.createDataFrame([("a", "yes"), ("b", " ")], "input_hash string, response string")
    assert {r["input_hash"]: r["status"] for r in external.replay(asked, known).collect()} == {"a": "OK", "b": "EMPTY", "c": "MISSING"}


def test_calls_are_tried_again(spark):
    def send(t):
        raise TimeoutError if t == "slow" else ValueError

    asked = spark.createDataFrame([("a", "slow"), ("b", "bad")], "input_hash string, input string")
    got = {r["input_hash"]: (r["status"], r["attempts"]) for r in external.call(asked, send, pause_s=0.0).collect()}
    assert got == {"a": ("ERROR", 2), "b": ("ERROR: ValueError", 1)}


def test_settings_keep_the_first(spark):
    lines = spark.createDataFrame([("# c",), ("A=1",), ("A=2",), (' B = "x=y" ',), ("none",)], "value string").coalesce(1)
    assert {r["key"]: r["setting"] for r in files.settings(lines).collect()} == {"A": "1", "B": "x=y"}


def test_batches_merge_and_may_come_again(spark, tmp_path):
    run = microbatch.upsert_into(str(tmp_path / "t"), "id", "n")
    schema = "id int, s string, n int"
    run(spark.createDataFrame([(1, "a", 1), (1, "b", 2)], schema), 0)
    for _ in range(2):
        run(spark.createDataFrame([(1, "", 3), (2, "c", 1)], schema), 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t/v=1")).collect())) == [(1, "b", 3), (2, "c", 1)]


def test_stream_of_files(spark, tmp_path):
    source, schema = tmp_path / "in", "id int, s string, n int"
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema).write.parquet(str(source / "x"))
    stream = spark.readStream.schema(schema).parquet(str(source / "*"))
    q = stream.writeStream.foreachBatch(microbatch.upsert_into(str(tmp_path / "t"), "id", "n")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "t/v=0")).count() == 2


SHORT = [
    "SSPAP WMKJWMDAROS1LRW16 010 1 CA + 01000",
    "SSPAP WMKJWMDAROS1LRW16 010 2P 0020",
    "SSPAP WMKJWMDAROS1L2RW16020AROSOWMEA1EE R CF + 06000 9000",
    "SSPAP WMKJWMDAROS1L2RW16020AROSOWMEA2P 12 0145",
    "SSPAP WMKJWMDAROS1L3NORTH030PIMOKWMEA1E TF 4000",
    "SSPAP WMKJWMDAROS1L2RW16040VAMOSWMPC1ETF x",
    "SSPAP WMKJWMDAROS1L2RW16 nothing",
    "SSPAP WMKJWMXAROS1L2RW16 010 1 CA",
]


def test_records_without_columns(spark):
    text = spark.createDataFrame([("\n".join([*SHORT, LINES[5]]),)], "text string")
    got = {(r.runway, r.transition_name, r.sequence): r for r in arinc424.read_legs(text).collect()}
    fields = lambda *k: tuple(got[k][c] for c in ("fix", "fix_section", "path_terminator", "turn_direction", "altitude_raw", "altitude_value", "distance_nm", "end_of_procedure"))
    assert fields("RW16", None, "010") == ("", None, "CA", None, "+01000", 1000.0, 2.0, False)
    assert fields("RW16", None, "020") == ("AROSO", "EA", "CF", "R", "+06000", 6000.0, 14.5, True)
    assert fields("", "NORTH", "030") == ("PIMOK", "EA", "TF", None, "4000", 4000.0, None, False)
    assert got["", "NORTH", "030"].branch_role == "ENROUTE"
    # a record of columns and one without them are one leg
    assert got["RW16", None, "040"].course_deg == 332.0 and len(got) == 4
