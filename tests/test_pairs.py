import json
import random

import pytest
from pyspark.sql import functions as F

from parcelflow.config import Curation, Dataset, from_mapping, load
from parcelflow.operators.dedup import keep_first, pair_digest
from parcelflow.operators.lookup import hot_keys, lookup_join
from parcelflow.operators.pairs import reply_pairs
from parcelflow.operators.sample import cut_points, flag_smallest, hash_order
from parcelflow.plans.curate import build_dataset, curate, manifest
from parcelflow.schemas import RAW_PAIRS, TWEETS
from parcelflow.sources.datasets import load_pairs, read_tweets, reader_for
from parcelflow.sources.pairs import read_manifest, read_pairs

TWEET_ROWS = [
    ("1", "True", "where is my parcel", "2.0"),
    ("2", "False", "checking now", None),
    ("3", "True", "lost package", None),
    ("4", "True", "late", "99"),
    ("5", "maybe", "hello", None),
    (" 6.0 ", " 1 ", "again, where", " 2 "),
    ("7", "TRUE", None, "2"),
    ("8", "true", "nan reply", "nan"),
]


def test_reply_pairs(spark):
    tweets = spark.createDataFrame(TWEET_ROWS, TWEETS)
    found = {tuple(r) for r in reply_pairs(tweets).collect()}
    assert found == {
        ("1", "where is my parcel", "checking now"), ("6", "again, where", "checking now"),
    }


def test_reply_pairs_reject_a_repeated_company_id(spark):
    rows = [("2", "False", "a", None), ("2.0", "0", "b", None), ("1", "True", "q", "2")]
    with pytest.raises(ValueError, match="reply_id"):
        reply_pairs(spark.createDataFrame(rows, TWEETS))


def test_reply_pairs_follow_id_lists_on_request(spark):
    rows = [("2", "False", "a", None), ("3", "False", "b", None), ("1", "True", "q", "2, 3")]
    tweets = spark.createDataFrame(rows, TWEETS)
    assert reply_pairs(tweets).count() == 0
    assert {r["assistant_raw"] for r in reply_pairs(tweets, split_ids=True).collect()} == {"a", "b"}


def test_tweets_from_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        "id,who,inbound,created,body,reply\n"
        '1,u,True,x,"two\nlines, ""quoted""",2.0\n2,c,False,x,NA,\n3,u,True,x,hi,2\n4,c,False,x,yes,3\n',
        encoding="utf-8",
    )
    mapping = {"user_col": "body", "tweet_id_col": "id", "response_tweet_id_col": "reply"}
    tweets = read_tweets(spark, str(path), mapping)
    assert tweets.columns == ["tweet_id", "inbound", "text", "response_tweet_id"]
    rows = {r["tweet_id"]: r for r in tweets.collect()}
    assert rows["1"]["text"] == 'two\nlines, "quoted"' and rows["2"]["text"] is None


def test_salted_lookup_equals_plain_join(spark):
    rng = random.Random(1)
    facts = spark.createDataFrame(
        [(i, 7 if rng.random() < 0.4 else rng.randint(0, 50)) for i in range(4000)], "i int, k int"
    )
    lookup = spark.createDataFrame([(k, f"v{k}") for k in range(0, 45)], "k int, v string")
    hot = hot_keys(facts, "k", share=0.1, min_rows=100)
    assert hot == [7] and hot_keys(facts, "k") == []
    for how in ("inner", "left"):
        salted = lookup_join(facts, lookup, "k", how, hot)
        plain = facts.join(lookup, "k", how)
        assert sorted(salted.select("i", "v").collect(), key=str) == sorted(plain.select("i", "v").collect(), key=str)
    parts = (
        lookup_join(facts, lookup.hint("shuffle_hash"), "k", "inner", hot)
        .filter("k = 7").withColumn("p", F.spark_partition_id()).select("p").distinct()
    )
    assert parts.count() >= 1


def test_keep_first_with_a_hot_text(spark):
    rng = random.Random(2)
    texts = ["Same text!" if rng.random() < 0.4 else f"text {rng.randint(0, 300)}" for _ in range(3000)]
    texts = [t.upper() if rng.random() < 0.5 else t for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "ord int, t string")
    kept = keep_first(rows, pair_digest(F.col("t")), "ord")
    expected = {}
    for i, t in enumerate(texts):
        expected.setdefault(t.lower().replace("!", ""), i)
    assert sorted(r["ord"] for r in kept.collect()) == sorted(expected.values())
    assert keep_first(kept, pair_digest(F.col("t")), "ord").count() == len(expected)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 5000, "c": 0}, {"a": 1, "b": 1}, {"b": 2500, "x": 3}, {}])
def test_flag_smallest_equals_ranking(spark, sizes):
    groups = {i: "b" if i % 6 else "a" if i % 4 else "c" for i in range(3000)}
    rows = spark.createDataFrame(list(groups.items()), "i int, g string").withColumn(
        "key", hash_order("s", F.col("i"))
    )
    flagged = {r["i"]: r["picked"] for r in flag_smallest(rows, "g", "key", sizes).collect()}
    keys = {r["i"]: r["key"] for r in rows.collect()}
    for g in set(groups.values()):
        members = sorted((i for i in groups if groups[i] == g), key=keys.get)
        n = sizes.get(g, 0)
        assert [flagged[i] for i in members] == [True] * min(n, len(members)) + [False] * (len(members) - n)


def test_cut_is_the_nth_key(spark):
    rows = spark.range(500).withColumn("g", F.lit("all")).withColumn("key", hash_order("x", F.col("id")))
    keys = sorted(r["key"] for r in rows.collect())
    assert cut_points(rows, "g", "key", {"all": 100}) == {"all": keys[99]}
    assert cut_points(rows, "g", "key", {"all": 500}) == {"all": keys[-1]}
    assert cut_points(rows, "g", "key", {"all": 501}) == {"all": "~"}


def raw_pairs(spark, n):
    rows = [
        ("kaggle_twitter" if i % 3 else "bitext_hf", str(i), i, f"order {i % 400}", f"reply {i % 400} pls")
        for i in range(n)
    ]
    return spark.createDataFrame(rows, RAW_PAIRS.replace("decimal(38,0)", "bigint")).withColumn(
        "ord", F.col("ord").cast("decimal(38,0)")
    )


def test_curate_sizes_and_split(spark):
    cfg = Curation(mini_size=200, val_ratio=0.12, ratios={"bitext_hf": 0.5, "kaggle_twitter": 0.1, "synthetic": 0.1})
    out = curate(raw_pairs(spark, 1000), cfg).collect()
    assert len(out) == 200 and len({r["input"] for r in out}) == 200
    assert sum(r["split"] == "val" for r in out) == 24
    assert sum(r["source"] == "bitext_hf" for r in out) >= 100
    again = curate(raw_pairs(spark, 1000).repartition(7), cfg).collect()
    assert sorted(out) == sorted(again)


def test_curate_cuts_ratios_above_one_and_keeps_one_for_validation(spark):
    cfg = Curation(mini_size=50, val_ratio=0.0, ratios={"bitext_hf": 1.0, "kaggle_twitter": 1.0})
    out = curate(raw_pairs(spark, 1000), cfg)
    counts = manifest(out, cfg).first()
    assert (counts["total_pairs"], counts["train_pairs"], counts["val_pairs"]) == (50, 49, 1)


def test_build_dataset_from_files(spark, tmp_path):
    tweets = tmp_path / "tweets.csv"
    lines = ["tweet_id,inbound,text,response_tweet_id"]
    for i in range(60):
        lines += [f"{2 * i},True,lost order {i} at UPS,{2 * i + 1}.0", f"{2 * i + 1},False,sorry {i} thx,"]
    tweets.write_text("\n".join(lines), encoding="utf-8")
    corpus = str(tmp_path / "corpus")
    spark.createDataFrame(
        [(f"track {i} é", f"bitext answer {i}") for i in range(80)] + [("no match", "none")] * 5,
        "instruction string, response string",
    ).write.parquet(corpus)
    settings = {
        "datasets": [
            {"name": "kaggle_twitter", "kind": "kaggle_csv", "path": str(tweets), "mapping": {"agent_col": "x"}},
            {"name": "bitext_hf", "kind": "hf", "path": corpus, "mapping": {}},
        ],
        "output": {"mini_size": 100, "val_ratio": 0.1, "max_tokens": 1024},
        "filters": {"shipping_keywords": ["track", "order"]},
        "anonymize": {"carrier_aliases": ["ups"], "replace_with": "Shipping_A"},
        "tone": {"normalize_agent_style": True, "prepend_steps": False},
        "ratios": {"bitext_hf": 0.7, "kaggle_twitter": 0.2},
    }
    job = tmp_path / "job.json"
    job.write_text(json.dumps(settings))
    cfg = load(str(job))
    assert cfg == from_mapping(settings)
    out = str(tmp_path / "out")
    counts = build_dataset(spark, cfg, out).first()
    assert (counts["total_pairs"], counts["train_pairs"], counts["val_pairs"]) == (100, 90, 10)
    assert read_manifest(spark, f"{out}/manifest").first().asDict() == counts.asDict()
    train, val = (
        {(r["input"], r["assistant_response"]) for r in read_pairs(spark, f"{out}/pairs", s).collect()}
        for s in ("train", "val")
    )
    assert len(train) == 90 and len(val) == 10 and not train & val
    assert any("at Shipping_A" in i and "thanks" in a for i, a in train)
    assert any("é" in i for i, _ in train)
    raw = [p.read_text(encoding="utf-8") for p in (tmp_path / "out" / "pairs").rglob("part-*")]
    assert any("é" in text for text in raw)


def test_settings_from_yaml(tmp_path):
    yaml = pytest.importorskip("yaml")
    settings = {
        "datasets": [{"name": "a", "kind": "hf", "hf_repo": "x/y", "split": "train", "mapping": {"user_col": "q"}}],
        "output": {"mini_size": 7, "val_ratio": 0.5, "max_tokens": 10},
        "filters": {"shipping_keywords": ["k"]},
        "anonymize": {"carrier_aliases": ["c"], "replace_with": "C"},
        "tone": {"normalize_agent_style": False, "prepend_steps": True},
    }
    path = tmp_path / "job.yaml"
    path.write_text(yaml.safe_dump(settings))
    cfg = load(str(path))
    assert cfg == from_mapping(settings)
    assert cfg.datasets[0].path == "x/y" and cfg.quotas() == {"bitext_hf": 4, "kaggle_twitter": 1, "synthetic": 0}


def test_instructions_from_json_lines(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = [("track", "a"), ("track", "a"), ("track", "b")]
    spark.createDataFrame(rows, "q string, r string").write.json(path)
    data = Dataset("bitext_hf", "hf", path, {"user_col": "q", "agent_col": "r"}, "json")
    pairs = load_pairs(spark, (data,))
    assert pairs.count() == 2 and pairs.select("ord").distinct().count() == 2


def test_unknown_kind_is_an_error():
    with pytest.raises(ValueError, match="unknown dataset kind"):
        reader_for("csv")
    assert reader_for("kaggle_anything") is reader_for("kaggle")


def test_curation_keeps_pairs_with_missing_or_repeated_ids_once(spark):
    from parcelflow.config import Curation
    from parcelflow.plans.curate import curate
    from parcelflow.sources.datasets import number_source

    rows = [(None, "where is parcel a", "reply a"), (None, "where is parcel b", "reply b"),
            (7, "lost parcel c", "reply c"), (7, "lost parcel d", "reply d"), (7, "lost parcel d", "reply d"),
            (None, "where is parcel a", "reply a")]
    pairs = spark.createDataFrame(rows, "local_ord bigint, input_raw string, assistant_raw string")
    pairs = number_source(pairs.withColumn("src_key", F.lit("k")), "s", 0)
    got = curate(pairs, Curation(keywords=("parcel",), ratios={"s": 0.5}, mini_size=10, prepend_steps=False))
    assert sorted(r["input"][-1] for r in got.collect()) == ["a", "b", "c", "d"]


def test_staged_tables_of_a_job_go_when_it_is_done(spark):
    import os

    from parcelflow.staging import scratch, stage

    with scratch(spark) as folder:
        assert stage(spark.range(3), "three").count() == 3
        path = folder.removeprefix("file:")
        assert os.listdir(path)
    assert not os.path.exists(path)
    with pytest.raises(ZeroDivisionError), scratch(spark) as folder:
        stage(spark.range(3), "three")
        1 / 0
    assert os.path.exists(folder.removeprefix("file:"))


def test_rows_without_a_key_are_spread_in_an_outer_join(spark):
    facts = spark.range(4000).selectExpr("id", "if(id % 4 = 0, 'a', null) AS k")
    lookup = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    for hot in (None, ["a"], hot_keys(facts, "k", share=0.1, min_rows=100)):
        joined = lookup_join(facts, lookup, "k", "left", hot)
        rows = {(r["id"], r["v"]) for r in joined.collect()}
        assert rows == {(i, 1 if i % 4 == 0 else None) for i in range(4000)}
    hot = hot_keys(facts, "k", share=0.1, min_rows=100)
    assert hot == ["a"] and hot.salts == [10]


@pytest.mark.parametrize("size", [7, 40, 300, 10**6])
def test_csv_in_splits_equals_the_whole_read(spark, tmp_path, size):
    from parcelflow.sources.datasets import csv_records

    rows = [(str(i), ['a', 'two\nlines', 'say ""hi""\n\n"', 'x, "y"', '', '"\n"', 'long ' * 9 + '\n' + 'é' * 9][i % 7], str(i % 3))
            for i in range(60)]
    quoted = lambda v: '"' + v.replace('"', '""') + '"' if v else ""
    for name, part in (("a.csv", rows[:35]), ("b.csv", rows[35:])):
        lines = ["id,text,n", *(",".join(map(quoted, r)) for r in part)]
        (tmp_path / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = csv_records(spark, str(tmp_path)).collect()
        whole = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    key = lambda r: tuple(x or "" for x in r)
    assert len(got) == 60 and sorted(map(key, got)) == sorted(map(key, whole))


def test_crowded_prefixes_and_many_groups(spark, monkeypatch):
    from parcelflow.operators import sample

    rows = spark.range(3000).selectExpr("id AS i", "cast(id % 3 AS string) AS g").withColumn(
        "key", hash_order("s", F.col("i"))
    )
    sizes = {"0": 17, "1": 400, "2": 5000}
    want = {r["i"]: r["picked"] for r in flag_smallest(rows, "g", "key", sizes).collect()}
    assert sum(want.values()) == 17 + 400 + 1000
    monkeypatch.setattr(sample, "PREFIX_HEX", 1)
    monkeypatch.setattr(sample, "MAX_RANKED", 3)
    monkeypatch.setattr(sample, "MAX_LITERALS", 2)
    assert {r["i"]: r["picked"] for r in flag_smallest(rows, "g", "key", sizes).collect()} == want


@pytest.mark.parametrize("size, breaks", [(90, "\n"), (1 << 20, "\n"), (80, "\r\n")])
def test_csv_with_stray_quotes_equals_the_whole_read(spark, tmp_path, size, breaks):
    import random

    from parcelflow.sources.datasets import csv_records

    draw = random.Random(size)
    cells = [
        "plain", "", 'my 5" box', 'a "quoted" word', '"closed"', '"with ""two"" inside"', '"one, two"', '"""edge"""',
        f'"two{breaks}lines"', f'"a ""b""{breaks}{breaks}c, d"', '"junk"after', 'x""y', " ", '""', '"ends with """',
    ]
    for name in ("a.csv", "b.csv"):
        rows = [[str(i), draw.choice(cells), draw.choice(cells)] for i in range(60)]
        text = breaks.join(",".join(r) for r in [["id", "x", "y"], *rows]) + breaks
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = csv_records(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(str(tmp_path)).collect()
    assert len(got) == 120 and sorted(map(tuple, got), key=repr) == sorted(map(tuple, whole), key=repr)


def test_a_stray_quote_loses_no_tweets(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        'tweet_id,inbound,text,response_tweet_id\n1,True,my 5" box is late,2\n2,False,sorry,\n'
        '3,True,"where, now?",4\n4,False,soon,\n5,True,ok 6" more,6\n6,False,fine,\n'
    )
    tweets = read_tweets(spark, str(path), splits=True).collect()
    assert sorted(tweets) == sorted(read_tweets(spark, str(path)).collect()) and len(tweets) == 6


def test_a_file_that_ends_inside_of_quotes_is_an_error(spark, tmp_path):
    from parcelflow.sources.datasets import csv_records

    path = tmp_path / "t.csv"
    path.write_text('id,x\n1,"open\n2,b\n3,c\n')
    with pytest.raises(ValueError, match="inside of quotes"):
        csv_records(spark, str(path))
    assert csv_records(spark, str(path), "keep").count() == 1
