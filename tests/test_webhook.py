import datetime as dt
import json

from pyspark.sql import functions as F

from chatloom.functions import bodies, captured, fixed
from chatloom.functions.captured import EntryMarks
from chatloom.operators import capture, webhook
from chatloom.plans.analysis import captured_messages
from chatloom.sources.live import ENVELOPE_SCHEMA
from tests.conftest import rows

AT = dt.datetime(2025, 5, 7, 18, 12)
SIGNED = {fixed.H_SIGNATURE: "s", fixed.H_MESSAGE_ID: "m1", fixed.H_TIMESTAMP: "2025-05-07T18:12:11", fixed.H_EVENT_TYPE: fixed.CHAT_EVENT}
FULL = {
    "message_id": "id_1",
    "broadcaster": {"is_anonymous": True, "user_id": 41, "username": "caster", "is_verified": False, "profile_picture": "", "channel_slug": "den", "identity": None},
    "sender": {"is_anonymous": False, "user_id": 7, "username": "viewer", "is_verified": True, "profile_picture": "https://example.com/v.png", "channel_slug": "v", "identity": {"username_color": "#0a7b3c", "badges": ["early"]}},
    "content": "çay hazır, başlayalım",
    "emotes": ["tea"],
}


def envelopes(spark, bodies_, headers=None):
    data = [(headers if headers is not None else {}, b if isinstance(b, str) or b is None else json.dumps(b), AT) for b in bodies_]
    return spark.createDataFrame(data, ENVELOPE_SCHEMA)


def normalised(spark, *bodies_, headers=None):
    return webhook.normalise_envelopes(envelopes(spark, bodies_, headers).coalesce(1)).collect()


def one(spark, body, headers=None):
    return normalised(spark, body, headers=headers)[0]


def test_full_and_minimal_payload(spark):
    row = one(spark, FULL, {"kick-event-type": fixed.CHAT_EVENT})
    assert (row.id, row.username, row.message, row.is_test, row.event_class, row.sentiment) == ("id_1", "viewer", "çay hazır, başlayalım", False, "kick", "N/A")
    row = one(spark, {"message_id": "x", "broadcaster": {"username": "b"}, "sender": {"username": "s"}, "content": "selam"})
    assert (row.username, row.message, row.event_class, row.reason) == ("s", "selam", "unknown", None)


def test_text_by_key_presence(spark):
    cases = [
        ({"content": "c", "message": "m"}, "c"),
        ({"content": "", "message": "m"}, "m"),
        ({"content": None, "text": "t"}, "t"),
        ({"message": None, "text": "t"}, None),
        ({"message": "", "msg": "x"}, None),
        ({"msg": "x"}, "x"),
        ({"content": 5}, "5"),
        ({"content": 0, "text": "t"}, "t"),
        ({"content": False}, None),
        ({"content": []}, None),
        ({}, None),
        ([1], None),
        ("7", None),
    ]
    got = [r.message for r in normalised(spark, *[c for c, _ in cases])]
    assert got == [want for _, want in cases]


def test_sender_by_key_presence(spark):
    cases = [
        ({"sender": {"username": "a"}, "username": "b"}, "a"),
        ({"sender": "a"}, "a"),
        ({"username": "b", "user": "c"}, "b"),
        ({"username": None, "user": "c"}, None),
        ({"user": "c", "sender": "a"}, "c"),
        ({"sender": {}, "broadcaster": {"username": "z"}}, "z"),
        ({"sender": {"id": 1}, "broadcaster": {"username": "z"}}, "z"),
        ({"sender": {"id": 1}, "user": "c"}, "c"),
        ({"username": "", "broadcaster": {"username": "z"}}, "z"),
        ({"broadcaster": "z"}, None),
        ({"sender": [1]}, None),
    ]
    got = [r.username for r in normalised(spark, *[c for c, _ in cases])]
    assert got == [want for _, want in cases]


def test_ids_are_stable(spark):
    a, b, c = normalised(spark, {"content": "x"}, {"content": "x"}, {"content": "y"})
    assert a.id == b.id != c.id and a.id.startswith("msg_")


def test_detection_of_test_events(spark):
    cases = [
        ({"a": "TeSt"}, True),
        ({"a": {"b": "my test"}}, True),
        ({"a": {"b": {"c": "test"}}}, False),
        ({"test": 1}, False),
        ({"a": ["test"]}, False),
        ({"a": {"b": ["test"]}}, False),
        ({"a": "debug_broadcaster"}, True),
        ({"a": "protesto"}, True),
        (["test"], False),
        ("\"test\"", False),
        ({"a": None, "b": 3, "c": "fine"}, False),
    ]
    got = [r.is_test for r in normalised(spark, *[c for c, _ in cases])]
    assert got == [want for _, want in cases]
    assert bodies._minimal(fixed.TEST_INDICATORS) == ["test", "debug_broadcaster"]


def test_form_and_broken_bodies(spark):
    got = normalised(spark, "content=hi&username=bob", "content=a&content=b&user=u", "content", "a=b=c", "content=x&y", "{broken", "", None, "content=&text=t&user=u")
    assert [(r.body_kind, r.message, r.username, r.reason) for r in got] == [
        ("form", "hi", "bob", None),
        ("form", "b", "u", None),
        ("invalid", None, None, "invalid_body"),
        ("invalid", None, None, "invalid_body"),
        ("invalid", None, None, "invalid_body"),
        ("invalid", None, None, "invalid_body"),
        ("invalid", None, None, "invalid_body"),
        ("invalid", None, None, "invalid_body"),
        ("form", "t", "u", None),
    ]


def test_nested_manual_event_is_rejected(spark):
    row = one(spark, {"event": "message_sent", "data": {"content": "c", "sender": {"username": "u"}}, "is_test_manual": True})
    assert row.reason == "no_message_or_sender" and row.body_head.startswith("{")


def test_counters_and_retrieval(spark):
    frame = envelopes(spark, [{"content": "c", "user": "u"}, {"content": "a test", "user": "u"}, "broken", {"x": 1}], {fixed.H_EVENT_TYPE: "any"})
    normal = webhook.normalise_envelopes(frame)
    assert tuple(webhook.webhook_counters(normal).first()) == (4, 2, 1, 0, AT)
    stored = webhook.stored_messages(normal)
    assert tuple(webhook.stored_counts(stored).first()) == (2, 1, 1)
    assert webhook.retrieval_filter(stored, test_only=True, real_only=True).first().message == "a test"
    assert webhook.retrieval_filter(stored, real_only=True).first().message == "c"
    assert webhook.retrieval_filter(stored).count() == 2


def test_admission_and_strict_projection(spark):
    cases = [
        (SIGNED, FULL, None),
        ({**SIGNED, fixed.H_SIGNATURE: ""}, FULL, "missing_header:" + fixed.H_SIGNATURE),
        ({}, FULL, f"missing_header:{fixed.H_SIGNATURE},{fixed.H_MESSAGE_ID},{fixed.H_TIMESTAMP}"),
        ({**SIGNED, fixed.H_EVENT_TYPE: "channel.followed"}, FULL, "event_type:ignore"),
        ({k: v for k, v in SIGNED.items() if k != fixed.H_EVENT_TYPE}, FULL, "event_type:unknown"),
        (SIGNED, "{broken", "invalid_json"),
        (SIGNED, {"content": ""}, "empty_content"),
        ({k.lower(): v for k, v in SIGNED.items()}, {"content": "x"}, None),
    ]
    data = [(h, b if isinstance(b, str) else json.dumps(b), AT) for h, b, _ in cases]
    events = webhook.chat_events(spark.createDataFrame(data, ENVELOPE_SCHEMA).coalesce(1))
    got = events.collect()
    assert [r.reason for r in got] == [want for _, _, want in cases]
    assert (got[0].username, got[0].message, got[0].msg_key, got[0].timestamp) == ("viewer", "çay hazır, başlayalım", "m1", "2025-05-07T18:12:11")
    assert got[7].username == fixed.UNKNOWN_SENDER
    assert webhook.accepted(events).count() == 2 and webhook.rejected(events).count() == 6


def test_bot_messages(spark):
    data = [("t", "u", "m", "c", False), ("t", None, "m", "c", None), ("t", "me", "m", "c", True), (None, "u", None, "c", False)]
    raw = spark.createDataFrame(data, "timestamp string, username string, message string, channel string, echo boolean").coalesce(1)
    assert [(r.username, r.reason) for r in webhook.bot_messages(raw).collect()] == [
        ("u", None), (fixed.UNKNOWN_SENDER, None), ("u", "missing_field:timestamp,message"),
    ]


# --- captured pages ---------------------------------------------------------------


def entry(msg_id, content='<span>hi</span> <img src="x">there', user="7", name="Ana", extra=""):
    uid = f'<div data-chat-entry-user-id="{user}">' if user else ""
    label = f'<span id="{user or fixed.NO_USER_ID}" style="color: #fff;"> {name} </span>' if name else ""
    body = f'<div class="chat-entry-content">{content}</div>' if content is not None else ""
    return f'<div data-chat-entry="{msg_id}">{uid}{label}{extra}{body}</div>'


def pages(spark, *htmls):
    return spark.createDataFrame([(i, h) for i, h in enumerate(htmls)], "page_id bigint, html string")


def test_entries_of_a_page(spark):
    html = "<html>" + entry("m1") + entry("m2", content="a<b>c</b> d > e <i", name=None) + entry("m3", content=None, user=None, name=None) + entry("m4", extra="chatroom-history-breaker")
    got = capture.newest_first(capture.page_entries(pages(spark, html))).collect()
    assert [(r.msg_id, r.content, r.user_id, r.username) for r in got] == [
        ("m3", "", fixed.NO_USER_ID, fixed.NO_USER_NAME),
        ("m2", "ac d  e", "7", fixed.NO_USER_NAME),
        ("m1", "hi there", "7", "Ana"),
    ]


def test_page_states(spark):
    frame = pages(spark, "x" + fixed.ERROR_PAGE_TEXT + entry("m"), fixed.SECURITY_PAGE_TEXT + entry("m"), "<html></html>", entry("m"))
    assert [r.page_state for r in capture.page_states(frame).orderBy("page_id").collect()] == ["error", "security_check", "no_entries", "entries"]
    assert capture.page_entries(frame).count() == 1


def test_same_id_on_two_pages_once(spark):
    frame = pages(spark, entry("m1", content="first") + entry("m2"), entry("m1", content="second") + entry("m3"))
    got = captured_messages(frame)
    assert sorted(r.msg_id for r in got.collect()) == ["m1", "m2", "m3"]
    assert got.filter("msg_id = 'm1'").first().content == "first"


def test_tag_stripping_equals_the_char_rule(spark):
    def by_char(s):
        out, inside = "", False
        for c in s:
            if c == "<":
                inside = True
            elif c == ">":
                inside = False
            elif not inside:
                out += c
        return out

    texts = ["a<b>c", "a<b", "a>b", "<<a>>b", "a<b\nc>d\n<e", "plain", "", "x<\n", "a&lt;b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(captured.strip_tags(F.col("t"))).collect()] == [by_char(t) for t in texts]


def test_marks_are_literal_text(spark):
    marks = EntryMarks(entry="a.b[", content="(x)", content_end="$")
    got = capture.page_entries(pages(spark, 'axb[no"a.b[id" (x)yes$no'), marks=marks).collect()
    assert [(r.msg_id, r.content) for r in got] == [("id", "yes")]


def test_routes_and_critical_errors(spark):
    data = [("message", "x"), ("status", "404"), ("error", "Got a 404 here"), ("error", "harmless"), ("warning", "w"), ("other_type", "x"), ("error", None), ("error", "TARAYICI BAŞLATILAMADI: Failed to initialize browser: x")]
    got = capture.route_events(spark.createDataFrame(data, "type string, data string").coalesce(1)).collect()
    assert [(r.route, r.is_critical) for r in got] == [
        ("message", False), ("status", False), ("error", True), ("error", False), ("warning", False), ("other", False), ("error", False), ("error", True),
    ]
    assert rows(capture.route_events(spark.createDataFrame(data, "type string, data string")).groupBy("route").count())
