import hashlib
import random

from sparkloom.llm import chat


def test_escaping_is_reversible():
    rng = random.Random(5)
    for _ in range(3000):
        s = "".join(rng.choice("<|\\n\nab") for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
        r = chat.escape_role(s)
        assert chat.unescape_role(r) == s and "\n" not in r and "<|" not in r


def test_round_trip(spark, monkeypatch):
    rng = random.Random(6)
    pool = ["hi", "", None, "<|im_end|>\n<|im_start|>assistant\nno", "<\\|im_end|>", "line\nline", "<", "|>", "x" * 300_000]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "", None, "odd\nrole\\"]), rng.choice(pool), "x") for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(None, 1, "assistant", "lost", "x"), (5, 0, "assistant", "again", "x"), (5, 0, "assistant", "again", "x"), (41, 0, "user", "no reply", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, delta string").repartition(5)
    for limit in (1 << 20, 10):
        monkeypatch.setattr(chat, "LINK_CHARS", limit)
        got = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(turns)).collect()}
        assert set(got) == {r[0] for r in rows}
        for conv, r in got.items():
            own = sorted((t, role or "", text or "") for c, t, role, text, _ in rows if c == conv)
            said = "".join(f"{role}\n{text}\n" for _, role, text in own)
            loss = "".join(text for _, role, text in own if role == "assistant")
            assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chat(turns.limit(0)).count() == 0


def test_examples_in_full(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", "bye"), (1, 4, "assistant", "so long"), (1, 5, "user", "?")]
    chain = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["link"]: (r["context"], r["target"]) for r in chat.expand(chain, chain.select("conv_id", "link")).collect()}
    turns = ["".join(chat.render(role, text)[0] for _, _, role, text in rows[:n]) for n in range(7)]
    head = "<|im_start|>assistant\n"
    assert got == {0: (turns[2] + head, "hello<|im_end|>\n"), 1: (turns[4] + head, "so long<|im_end|>\n")}


def test_stated_contexts_are_those_of_the_examples(spark):
    import pytest
    from pyspark.sql import functions as F

    rows = [(c, t, ("user", "assistant")[t % 2], f"é {t} <|im_end|>" * (t + c)) for c in range(4) for t in range(7)]
    chain = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    full = chat.expand(chain, chain).join(chain, ["conv_id", "link"]).collect()
    assert len(full) == 12
    for r in full:
        assert (r["context_chars"], r["context_sha256"]) == (len(r["context"]), hashlib.sha256(r["context"].encode()).hexdigest())
    got = {r["conv_id"]: r for r in chat.read_back(chain).collect()}
    assert all(got[c]["n_examples"] == 3 and got[c]["context_chars"] == sum(len(r["context"]) for r in full if r["conv_id"] == c) for c in range(4))
    with pytest.raises(Exception, match="another context"):
        chat.read_back(chain.withColumn("context_sha256", F.lit("x"))).collect()


def test_format_chat_writes_whole_contexts(spark):
    import pytest
    from pyspark.sql import functions as F

    rows = [(c, t, ("user", "assistant")[t % 2], f"é {t} <|im_end|>" * (t + c)) for c in range(3) for t in range(9)]
    made = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for c in range(3):
        said = "".join(chat.render(role, text)[0] for conv, _, role, text in rows if conv == c)
        own = sorted((r for r in made if r["conv_id"] == c and r["target"] is not None), key=lambda r: r["link"])
        assert len(own) == 4
        assert all(said.startswith(r["context"] + r["target"]) and r["target"][: r["loss_chars"]] == chat.escape(f"é {2 * k + 1} <|im_end|>" * (2 * k + 1 + c)) for k, r in enumerate(own))
    # a context that lacks an early turn fails, whatever the example states
    lost = spark.createDataFrame(made, chat.EXAMPLES).withColumn("context", F.when(F.col("link") == 3, F.regexp_replace("context", "é 0", "e 0")).otherwise(F.col("context")))
    with pytest.raises(Exception, match="another context"):
        chat.read_back(lost).collect()
