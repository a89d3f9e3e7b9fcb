import hashlib
import random

from helpers import rows
from pyspark.sql import functions as F

from adlake.llm import chat

TRAPS = ["", "\\", "<|", "|>", "<\\|im_end|>", "<|im_end|>\n<|im_start|>assistant\nhi", "\\n", "\n", "a\\\\n\\\n", "é😀<", "|im_end|>\n",
         "<|im_start|>", "\\\\<|", "<", "tail<", "<<|im_end|>"]


def test_round_trip_of_any_roles_and_texts(spark):
    rng = random.Random(3)
    data = [(c, t, rng.choice(["user", "assistant", "system", *TRAPS, None]), rng.choice([*TRAPS, None, "plain"]), "x")
            for c in range(120) for t in range(rng.randrange(1, 7))]
    data += [(200, 0, "user", "q", ""), (200, 1, "assistant", "a", ""), (201, 0, "system", None, ""), (201, 1, "user", "q", ""), (201, 2, "assistant", None, ""),
             (202, 1, "user", "same turn", ""), (202, 1, "assistant", "same turn", ""), (202, None, "system", "null turn", ""), (None, 0, "user", "no id", ""),
             (203, 0, "user", "x" * 300_000, ""), (203, 1, "assistant", "y" * 300_000, ""), (204, 0, "gpt", "kept role", ""), (204, 1, "human", "kept role", "")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted string")
    texts = chat.formatted(chat.canonical(chat.as_records(df), ("conv_id",)))
    got = {r["conv_id"]: r for r in rows(chat.read_back(texts.select("conv_id", "layout", "formatted", "loss_mask")))}
    want = {}
    for c, t, role, text, _ in data:
        want.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(want)
    assert {r["layout"] for r in got.values()} == {"prompt", "instruction", "shared", "messages"}
    for c, turns in want.items():
        turns = [(role, text) for _, _, role, text in sorted(turns)]
        r = got[c]
        assert [(t["role"], t["text"]) for t in r["turns_back"]] == turns
        assert r["loss_text"] == "".join(t for role, t in turns if role == "assistant")
        assert sum(m["skip"] + m["take"] + m["rest"] for m in r["loss_mask"]) == len(r["formatted"])
        at, masked = 0, ""
        for m in r["loss_mask"]:
            masked += r["formatted"][at + m["skip"]:at + m["skip"] + m["take"]]
            at += m["skip"] + m["take"] + m["rest"]
        assert masked.replace("<\\|", "<|").replace("\\\\", "\\") == r["loss_text"]
        assert r["formatted"].count(chat.START) == len(turns) and r["formatted"].count(chat.END) == len(turns)


def test_fingerprint_selects_the_mapping(spark):
    schema = ("id long, prompt string, completion string, instruction string, input string, output string, "
              "messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, extra string")
    none = (None,) * 8
    data = [(1, "p", "c", *none[2:]), (2, None, None, "s", "u", "a", *none[5:]), (3, None, None, "u", None, "a", *none[5:]),
            (4, *none[:5], [("user", "u"), (None, None)], None, None), (5, *none[:6], [("human", "u"), ("gpt", "a"), ("tool", "t")], None),
            (6, "p", *none[1:]), (7, "p", "c", *none[2:7], "more"), (8, *none), (9, *none[:5], [], None, None)]
    got = {r["id"]: r for r in rows(chat.canonical(spark.createDataFrame(data, schema), ("id",)))}
    said = {i: None if r["turns"] is None else [(t["role"], t["text"]) for t in r["turns"]] for i, r in got.items()}
    assert said == {1: [("user", "p"), ("assistant", "c")], 2: [("system", "s"), ("user", "u"), ("assistant", "a")],
                    3: [("user", "u"), ("assistant", "a")], 4: [("user", "u"), ("", "")], 5: [("user", "u"), ("assistant", "a"), ("tool", "t")],
                    6: None, 7: None, 8: None, 9: []}
    assert got[1]["fingerprint"] == hashlib.sha256(b"completion|prompt").hexdigest()
    assert got[6]["layout"] is None and got[4]["fingerprint"] == hashlib.sha256(b"messages[].content|messages[].role").hexdigest()


def test_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted(chat.canonical(chat.as_records(empty), ("conv_id",))).count() == 0
    no_turns = spark.createDataFrame([(1, [])], f"conv_id long, turns {chat.TURNS}")
    assert rows(chat.read_back(chat.formatted(no_turns)).select("formatted", F.size("turns_back").alias("n"), "loss_text")) == [
        {"formatted": "", "n": 0, "loss_text": ""}]


def test_optional_nested_fields_count_where_they_are_filled(spark):
    schema = ("id long, messages array<struct<role:string,content:string,name:string,extra:struct<weight:int>>>, "
              "conversations array<struct<`from`:string,value:string,role:string>>")
    data = [(1, [("user", "a", None, None), ("assistant", None, None, (None,))], None), (2, [], None), (3, [("user", None, None, None)], None),
            (4, [("user", "a", None, None), ("user", "b", "Ann", None)], None), (5, [("user", "a", None, (1,))], None),
            (6, None, [("human", "q", None)]), (7, None, [("human", "q", "x")]), (8, None, None)]
    got = {r["id"]: (r["layout"], r["turns"] and [t["text"] for t in r["turns"]]) for r in rows(chat.canonical(spark.createDataFrame(data, schema), ("id",)))}
    assert got == {1: ("messages", ["a", ""]), 2: ("messages", []), 3: ("messages", [""]), 4: (None, None), 5: (None, None),
                   6: ("shared", ["q"]), 7: (None, None), 8: (None, None)}
