from parcelflow.config import Dataset
from parcelflow.sources import datasets


def test_tweets_of_a_dataset_are_read_in_splits(spark, tmp_path, monkeypatch):
    read, path = [], tmp_path / "tweets.csv"
    path.write_text(
        "tweet_id,inbound,text,response_tweet_id,in_response_to_tweet_id\n"
        '1,True,"where is\n""my"" parcel",2,\n2,False,on its way,,1\n'
    )
    plain = datasets.csv_records
    monkeypatch.setattr(datasets, "csv_records", lambda s, p: read.append(p) or plain(s, p))
    rows = datasets.load_pairs(spark, (Dataset("tweets", "kaggle", str(path)),)).collect()
    assert [(r["input_raw"], r["assistant_raw"]) for r in rows] == [('where is\n"my" parcel', "on its way")]
    assert read == [str(path)]
