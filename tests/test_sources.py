import pytest
from pyspark.sql import functions as F

from chatloom.sources import chat_csv, sinks
from tests.conftest import rows


def write(path, text, bom=False):
    path.write_bytes((b"\xef\xbb\xbf" if bom else b"") + text.encode())
    return str(path)


def test_chat_log_with_mark_quotes_and_empty_text(spark, tmp_path):
    path = write(tmp_path / "log.csv", 'timestamp,username,message\n2025-05-07T22:23:13.151683,ana,"say ""hi"", ok"\n2025-05-07T22:23:14,bob,\nlater,eve,null\n', bom=True)
    chat = chat_csv.read_chat_log(spark, path)
    assert chat.columns[:3] == ["timestamp", "username", "message"]
    got = chat.orderBy("username").collect()
    assert [r.message for r in got] == ['say "hi", ok', None, "null"]
    assert tuple(chat_csv.unread_times(chat).first()) == (3, 1)


def test_schema_rules(spark, tmp_path):
    raw = chat_csv.read_chat_log(spark, write(tmp_path / "raw.csv", "username,content,msg_id,user_id,timestamp\nu,hello,id1,7,2025-01-01T00:00:00\n"))
    row = raw.first()
    assert (row.message, row.msg_key) == ("hello", "id1")
    with pytest.raises(ValueError, match="timestamp"):
        chat_csv.read_chat_log(spark, write(tmp_path / "a.csv", "message\nx\n"))
    with pytest.raises(ValueError, match="content"):
        chat_csv.read_chat_log(spark, write(tmp_path / "b.csv", "timestamp,text\nt,x\n"))


def test_labelled_folder(spark, tmp_path):
    write(tmp_path / "1.csv", "message,label\nm1,positive\nm1,positive\n")
    write(tmp_path / "2.csv", "content,message,label\nc1,ignored,negative\n")
    write(tmp_path / "3.csv", "text,label\nskipped,neutral\n")
    write(tmp_path / "4.csv", "message,label\nm2,neutral\n")
    write(tmp_path / "5.csv", "")
    write(tmp_path / "note.txt", "message,label\nno,no\n")
    assert rows(chat_csv.read_labelled(spark, str(tmp_path))) == [("c1", "negative"), ("m1", "positive"), ("m1", "positive"), ("m2", "neutral")]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        chat_csv.read_labelled(spark, str(tmp_path / "none"))


def test_comparison_inputs(spark, tmp_path):
    predicted = chat_csv.load_predicted(spark, write(tmp_path / "p.csv", ",timestamp,username,message,sentiment\n0,t,u,m,positive\n", bom=True))
    assert rows(predicted) == [("t", "u", "m", "positive")]
    assert predicted.columns == ["timestamp", "username", "message_text", "predicted_label"]
    actual = chat_csv.load_actual(spark, write(tmp_path / "a.csv", "username,content,msg_id,user_id,timestamp,label\nu,m,1,2,t,neutral\n"))
    assert actual.columns == ["timestamp", "username", "message_text", "actual_label"]
    with pytest.raises(ValueError, match="sentiment"):
        chat_csv.load_predicted(spark, write(tmp_path / "bad.csv", "timestamp,username,message\nt,u,m\n"))


def test_log_sink(spark, tmp_path):
    out = str(tmp_path / "log")
    df = spark.createDataFrame([("t", "hi", "my room", 1), ("t2", 'a "b"', "my room", 2)], "timestamp string, content string, channel string, extra int")
    assert sinks.write_chat_log(df, out) == ["username"]
    back = spark.read.option("header", True).option("escape", '"').csv(out)
    assert back.columns == ["timestamp", "username", "message", "channel"]
    assert rows(back.select("timestamp", "message", "channel")) == [("t", "hi", "my_room"), ("t2", 'a "b"', "my_room")]
    nothing = tmp_path / "nothing"
    sinks.write_chat_log(df.limit(0), str(nothing))
    assert not nothing.exists()


def test_audit_and_clear(spark, tmp_path):
    path = str(tmp_path / "audit")
    df = spark.createDataFrame([({"a": "b"}, "{broken")], "headers map<string,string>, body string").withColumn("received_at", F.lit("2025-01-01").cast("timestamp"))
    sinks.append_audit(df, path)
    sinks.append_audit(df, path)
    assert spark.read.parquet(path).count() == 2
    schema = spark.read.parquet(path).schema
    sinks.clear_stored(spark, path)
    assert spark.read.schema(schema).parquet(path).count() == 0
