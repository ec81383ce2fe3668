import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from apitables.llm import chat

PIECES = st.lists(st.sampled_from([*chat.CONTROL, "\\", ".", "n", "\n", "<", "|", ">", "[", "é", "\\n", "\\."]), max_size=12).map("".join)


@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
@settings(max_examples=300, deadline=None)
def test_formatted_turns_are_read_back(turns):
    made = [chat.segment(role, text) for role, text in turns]
    assert chat.read_back("".join(m[0] for m in made)) == turns
    assert [chat.unescape(m[0][m[1] : m[2]]) for m in made] == [text for _, text in turns]
    inside = "".join(m[0][m[1] : m[2]] for m in made)
    assert not any(c in inside for c in chat.CONTROL)


def _turns(spark, records, **names):
    rows = [(i, 0, r if r is None or isinstance(r, str) else json.dumps(r), "x") for i, r in enumerate(records)]
    df = spark.createDataFrame(rows, "id long, turn long, record string, role string")
    found = chat.canonical_turns(df, **names).orderBy("id", "place").collect()
    return [[(r["role"], r["text"]) for r in found if r["id"] == i] for i in range(len(records))], found


def test_layouts(spark):
    records = [
        {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": None}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "u", "response": "a", "id": 3}, {"prompt": "u", "completion": "a"},
        {"instruction": "i", "input": "n", "output": "o"}, {"instruction": "i", "input": None, "output": "o"},
        {"question": "q", "answer": "a", "system": "s"}, {"role": "user", "text": "t"}, {"role": None}, {}, {"messages": []},
        {"unheard": 1}, [1], "not json", None, {"prompt": "u"},
    ]
    got, rows = _turns(spark, records)
    assert got[:11] == [
        [("system", "s"), ("user", ""), ("assistant", "a")], [("user", "u"), ("assistant", "a")], [("user", "u"), ("assistant", "a")], [("user", "u"), ("assistant", "a")],
        [("user", "i"), ("user", "n"), ("assistant", "o")], [("user", "i"), ("assistant", "o")], [("system", "s"), ("user", "q"), ("assistant", "a")], [("user", "t")], [("", "")], [("", "")], []]
    assert got[11:] == [[(None, None)]] * 5
    assert len({r["fingerprint"] for r in rows if r["id"] in (4, 5)}) == 2 and not any(r["layout"] for r in rows if r["id"] > 10)


def test_list_layouts_with_ids_and_without_objects(spark):
    turns = [("user", "u"), ("assistant", "a")]
    records = [
        {"id": "x", "conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}]},
        {"id": 1, "messages": [{"role": "user", "content": "u", "name": "n"}, {"role": "assistant", "content": "a", "id": 2}]},
        {"messages": ["u", "a"]}, {"messages": "u"}, {"conversations": [{"from": "human", "value": "u"}, "a"]},
        {"messages": [{"role": "assistant", "content": "a", "tool_calls": "t"}]},
    ]
    got, rows = _turns(spark, records)
    assert got == [turns, turns] + [[(None, None)]] * 4 and not any(r["layout"] for r in rows if r["id"] > 1)


def test_digests_stream_long_repeated_and_nameless_conversations(spark):
    rows = [(1, 1, "assistant", "b </s>"), (1, 0, "user", "a"), (2, 0, None, None), (2, 0, None, None), (None, 0, "assistant", "x"), (3, 0, "assistant", "y" * 200000)] + [(4, i, "assistant", str(i)) for i in range(3000)]
    df = spark.createDataFrame([(i, t, json.dumps({"role": r, "text": x})) for i, t, r, x in rows], "id long, turn long, record string")
    got = {r["id"]: r for r in chat.digests(chat.format_turns(chat.canonical_turns(df))).collect()}
    for key in {r[0] for r in rows}:
        turns = sorted([(t, r or "", x or "") for i, t, r, x in rows if i == key])
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        assert got[key]["n_turns"] == len(turns) and got[key]["loss_chars"] == len(learnt)
        assert got[key]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[key]["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()
    assert chat.digests(chat.format_turns(chat.canonical_turns(df.limit(0)))).collect() == []
