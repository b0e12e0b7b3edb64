import json

from tidebar.llm import chat
from tidebar.llm.chat import Parameter

SCHEMAS = {
    "find": {"q": Parameter("string", True, 1, 5), "top": Parameter("integer", False, 1, 10)},
    "add": {"x": Parameter("number", True), "deep": Parameter("object"), "mode": Parameter("string", among=("a", "b"))},
}


def messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, kind string, body string")


def call(id_, name="find", after=None, **arguments):
    return json.dumps({"name": name, "id": id_, "arguments": arguments} | ({"after": after} if after else {}))


def result(id_, content="ok"):
    return json.dumps({"content": content, "id": id_})


def test_links_levels_errors_and_json(spark):
    rows = [
        (1, 0, "call", call("a", q="x")), (1, 1, "result", result("a")),
        (1, 2, "call", call("b", "add", after="a", x=1.50, deep={"z": 1, "b": [2, None]})), (1, 9, "result", result("b")),
        (1, 3, "call", call("c", after="b", q="toolong", top=0)),
        (1, 4, "call", call("d", "nothing")), (1, 5, "call", call("e", after="gone", top="1", more=2)),
        (1, 6, "call", call("f", after="g", q="x")), (1, 7, "call", call("g", after="f", q="x")),  # a cycle
        (1, 8, "call", call("h", after="h", q="x")),
        (1, 10, "result", result("a", "again")), (1, 11, "result", result("zzz")), (1, 12, "call", call("a", q="y")),
        (1, 13, "call", "{not json"), (1, 14, "call", None), (1, 15, "call", json.dumps({"id": "i", "name": "find", "arguments": [1]})),
        (1, 16, "call", call("j", "add", x="1", mode="c")),
        (2, 0, "call", call("a", q="x")), (None, 0, "call", call("a", q="x")), (None, 1, "result", result("a")),
    ]
    out = {(r["conv_id"], r["turn"]): r for r in chat.linked(messages(spark, rows), SCHEMAS).collect()}
    assert len(out) == len(rows) - 3  # the answers of a, b and a are in the rows of their calls
    one = lambda turn, conv=1: (out[conv, turn]["status"], out[conv, turn]["level"], out[conv, turn]["errors"])
    assert one(0) == ("answered", 0, [])
    assert one(2) == ("answered", 1, [])
    assert one(3) == ("unanswered", 2, ["q: range", "top: range"])
    assert one(4) == ("unanswered", 0, ["unknown tool"])
    assert one(5) == ("unanswered", 0, ["more: unknown", "q: missing", "top: type", "unknown predecessor"])
    assert one(6) == one(7) == one(8) == ("unanswered", None, ["cycle"])
    assert one(10) == ("repeated", None, []) and one(11) == ("orphan", None, []) and one(12) == ("repeated", None, [])
    assert one(13) == one(14) == ("repeated", None, [])
    assert one(15) == ("unanswered", 0, ["not an object"])
    assert one(16) == ("unanswered", 0, ["mode: range", "x: type"])
    assert one(0, 2) == ("unanswered", 0, []) and one(0, None) == ("answered", 0, [])
    for (_, turn), r in out.items():
        if turn in (0, 2, 3):
            assert r["json"] == json.dumps(json.loads(r["json"]), sort_keys=True, separators=(",", ":"))
    assert json.loads(out[1, 2]["json"])["result"]["content"] == "ok"


def test_long_chains_need_few_rounds(spark):
    n = 500
    df = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None) for i in range(n)], "node string, parent string")
    levels = {r["node"]: r["level"] for r in chat.levels(df).collect()}
    assert levels == {f"n{i}": i for i in range(n)}


def test_turns(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", "r\n\"é\""), (2, 0, "user", ""), (2, 1, "user", None),
            (3, 5, "assistant", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {(r["conv_id"], r["turn"]): r for r in chat.linked(chat.turns_as_messages(df), chat.TURN_SCHEMAS).collect()}
    assert (out[1, 1]["status"], out[1, 1]["level"], out[1, 1]["errors"]) == ("answered", 0, [])
    assert (out[1, 3]["status"], out[1, 3]["level"], out[1, 3]["errors"]) == ("unanswered", 1, [])
    assert json.loads(out[1, 3]["json"])["call"]["arguments"]["text"] == "r\n\"é\""
    assert out[2, 0]["errors"] == ["chars: range", "text: range"] and "text: missing" in out[2, 1]["errors"]
    assert out[3, 5]["status"] == "orphan"
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.linked(chat.turns_as_messages(empty), chat.TURN_SCHEMAS).count() == 0


def test_every_row_comes_back(spark):
    """Repeated rows, two bodies at one turn and null turns: one is the head, the others are repeated."""
    rows = [
        (1, 0, "call", call("a", q="x"))] * 3 + [(1, 0, "call", call("a", q="y")), (1, None, "call", call("a", q="z")),
        (1, 1, "result", result("a"))] + [(1, 1, "result", result("a", "other"))] * 2 + [(1, None, "result", result("a")),
        (2, None, "call", call("b", q="x")), (2, None, "call", call("b", q="x")), (2, None, "result", result("b")),
        (3, 4, "result", result("c")), (3, 4, "result", result("c")),
    ]
    out = chat.linked(messages(spark, rows), SCHEMAS).collect()
    statuses = sorted((r["conv_id"], r["status"]) for r in out)
    assert statuses == sorted(
        [(1, "answered")] + [(1, "repeated")] * 7 + [(2, "answered"), (2, "repeated")] + [(3, "orphan")] * 2
    )
    head = next(r for r in out if (r["conv_id"], r["status"]) == (1, "answered"))
    assert head["turn"] == 0 and json.loads(head["json"])["call"]["arguments"]["q"] in ("x", "y")
    again = chat.linked(messages(spark, rows[::-1]), SCHEMAS).collect()
    assert next(r["json"] for r in again if (r["conv_id"], r["status"]) == (1, "answered")) == head["json"]
