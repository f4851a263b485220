from pyspark.sql import functions as F

from trajlens.functions import actions as A
from trajlens.functions import suffixes as U
from trajlens.functions.ranks import dedupe_actions, replacement_candidates


def pairs(spark, fn, data):
    frame = spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(data)], "i int, p string, c string")
    return [r[0] for r in frame.orderBy("i").select(fn(F.col("p"), F.col("c"))).collect()]


def test_semantic_undo(spark):
    data = [
        ("go up", "go down"), ("open the Door!", "close the door"), ("open door", "close chest"), ("unlock door with key", "lock the door"),
        ("unlock door with key", "lock the chest with rope"), ("take apple from table", "put apple on shelf"), ("take apple", "drop pear"),
        ("insert coin into slot", "take coin from slot"), ("take", "drop"), (None, "look"),
    ]
    assert pairs(spark, A.is_semantic_undo, data) == [True, True, False, True, False, True, False, True, False, False]


def test_moved_object(spark):
    frame = spark.createDataFrame([("take red key from box",), ("drop key",), ("put key in box on floor",), ("look",), ("",)], "a string")
    assert [r[0] for r in frame.select(A.moved_object(F.col("a"))).collect()] == ["red key", "key", "key", "", ""]


def test_objective_overlap(spark):
    data = [("go north", "Head NORTH now"), ("go up", "upstairs please"), ("take brass key", "get the brass lamp"), ("take it", ""), ("do", "do it")]
    assert pairs(spark, A.objective_overlap, data) == [1.0, 0.0, 1 / 3, 0.0, 0.0]


def test_pool_orders(spark):
    frame = spark.createDataFrame([(["look", "go north", "open box", "go south"], ["go south", "go north"])], "pool array<string>, history array<string>")
    default = frame.select(A.rank_pool(F.col("pool"), F.col("history"), F.lit("")).alias("r")).first()["r"]
    assert default == ["open box", "look", "go north", "go south"]
    progress = frame.select(A.rank_pool(F.col("pool"), F.col("history"), F.lit("open the box"), "progress").alias("r")).first()["r"]
    assert progress[0] == "open box" and progress[-1] == "go south"


def test_unicode_space_and_verbs(spark):
    frame = spark.createDataFrame([("  Go \tNORTH \n",), ("   ",), (None,)], "a string")
    assert [r[0] for r in frame.select(A.normalize_action(F.col("a"))).collect()] == ["go north", "", None]
    assert [r[0] for r in frame.select(A.action_group(F.col("a"))).collect()][:2] == ["navigation", "other"]


def test_lists(spark):
    frame = spark.createDataFrame([(["a", "A ", "b", "a", "c"], "b")], "c array<string>, x string")
    row = frame.select(dedupe_actions(F.col("c")).alias("d"), replacement_candidates(F.col("c"), F.col("x"), 2).alias("r")).first()
    assert row["d"] == ["a", "b", "c"] and row["r"] == ["a", "A "]


def test_suffixes(spark):
    frame = spark.createDataFrame([
        (["a", "b", "c"], ["x", "a", "c", "b"]), (["a"], []), ([], ["a"]), (["a", "a"], ["a", "a", "a"]),
    ], "plan array<string>, history array<string>")
    assert [r[0] for r in frame.select(U.remaining_suffix(F.col("plan"), F.col("history"))).collect()] == [["c"], ["a"], [], []]
    frame = spark.createDataFrame([
        (["open door to hall", "go to hall", "x"], ["teleport to hall"]), (["open door to hall", "look"], ["teleport to hall"]),
        (["examine jar"], ["look in jar", "look at jar"]), (["wait"], []), ([], ["a"]),
    ], "s array<string>, adm array<string>")
    assert [r[0] for r in frame.select(U.adapt_suffix(F.col("s"), F.col("adm"))).collect()] == [
        ["teleport to hall", "x"], ["open door to hall", "look"], ["look at jar"], ["wait"], []]


def test_texts_are_read_once_per_row(spark):
    frame = spark.createDataFrame([(["take key", "Drop  KEY!"], ["take key"], "find key")], "pool array<string>, history array<string>, goal string")
    found = frame.select(A.rank_pool(F.col("pool"), F.col("history"), F.col("goal"), "progress").alias("r"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(goal") == 1
    assert plan.count("slice(history") <= 2
    weights = {"recent_repeat": 1.0, "semantic_undo": 1.5, "overlap_bonus": 0.7, "off_objective": 0.9, "static": 0.5}
    got = frame.select(F.transform("pool", lambda a: A.structural_penalty(a, F.col("history"), F.col("goal"), **weights))).first()[0]
    assert got == [1.0 - 0.7 * 0.5, 1.5 - 0.7 * 0.5]


def test_undo_of_odd_texts(spark):
    data = [
        ("put a in on b", "take a"), ("take  red-key from box", "drop red key"), ("open", "close"), ("GO NORTH", "go south"), ("lock", "unlock"),
        ("take Ä-x", "drop ä x"), ("open a  b", "close a b"), ("unlock the door", "lock a the"), ("take from box", "drop"), ("", ""),
    ]
    assert pairs(spark, A.is_semantic_undo, data) == [True, True, True, True, False, True, False, False, False, False]
