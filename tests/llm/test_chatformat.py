import random

from pyspark.sql import functions as F

from tallyloom.llm import chatformat

SCHEMA = f"conv_id long, turn long, role string, parts array<{chatformat.PART_TYPE}>"


def text(words):
    return ("text", words, None, None, None, None, None)


def read(df):
    made = df.select("*", chatformat.whole_text(F.col("segments")).alias("text")).select("*", chatformat.read_back(F.col("text")).alias("back"))
    return {r.conv_id: r for r in made.collect()}


def test_texts_of_control_strings_come_back(spark):
    rng = random.Random(4)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<sys>", "</sys>", "<part>", "<image>", "[TURN:", "[/TURN]", "\\", "<", "[", "/s>", "INST]",
            "$1", "é", "😀", "\n", " ", "x", "%5D", "]"]
    rows = [(c, k, rng.choice(["user", "assistant", "system", "", "tool]x", "a%5D[<s>", "user "]),
             [text("".join(rng.choices(bits, k=rng.randint(0, 9)))) for _ in range(rng.randint(1, 3))])
            for c in range(150) for k in range(rng.randint(1, 4))]
    rows.append((900, 0, "user", [text("</s>[INST] ok [/INST]")]))
    got = read(chatformat.formatted(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    for c in {r[0] for r in rows}:
        turns = [(r[2], [("text", p[1]) for p in r[3]]) for r in rows if r[0] == c]
        assert [(t.role, [tuple(p) for p in t.parts]) for t in got[c].back] == turns
        assert got[c].n_turns == len(turns)
    assert got[900].text == "[INST]<\\/s>[\\INST] ok [\\/INST][/INST]"


def test_attachments_in_order_with_their_tokens(spark):
    parts = [("image", None, "a.png", 57, 28, None, None), text("see <image> and"), ("audio", None, "b.wav", None, None, 1.5, None),
             ("document", None, "c.pdf", None, None, None, 3), ("video", None, "d", None, None, None, None), (None, "end", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 1, "assistant", parts), (1, None, "user", [("image", "x", None, None, -5, None, None)]), (1, 2, "user", None)], SCHEMA)
    row = read(chatformat.formatted(df))[1]
    assert [(a.turn_no, a.kind, a.ref, a.n_tokens) for a in row.attachments] == [
        (0, "image", None, 1), (1, "image", "a.png", 3), (1, "audio", "b.wav", 38), (1, "document", "c.pdf", 1536), (1, "video", "d", 1)]
    assert row.attachment_tokens == 1579
    assert [[(p.kind, p.text) for p in t.parts] for t in row.back] == [
        [("image", None)], [("image", None), ("text", "see <image> and"), ("audio", None), ("document", None), ("file", None), ("text", "end")], [("text", "")]]
    assert [s.text for s in row.segments if s.loss] == ["<image><part>see <\\image> and<part><audio><part><document><part><file><part>end"]


def test_nulls_ties_long_texts_and_empty_table(spark):
    rows = [(None, 0, None, [text(None)]), (7, 0, "user", [text("b")]), (7, 0, "assistant", [text("a")]), (7, 0, "user", [text("b")]),
            (8, 0, "assistant", [text("</s>" * 100_000)])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS segments", "2 AS turns", "3 AS at")
    got = read(chatformat.formatted(df))
    assert [(t.role, t.parts[0].text) for t in got[7].back] == [("assistant", "a"), ("user", "b"), ("user", "b")]
    assert [(t.role, t.parts[0].text) for t in got[None].back] == [("", "")]
    assert got[8].back[0].parts[0].text == "</s>" * 100_000 and len(got[8].text) == 500_007
    assert chatformat.formatted(df.limit(0)).count() == 0


def test_many_turns(spark):
    df = spark.range(5000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise(
        "assistant").alias("role"), F.array(chatformat.text_part(F.concat(F.lit("<s>"), F.col("id").cast("string")))).alias("parts"))
    row = chatformat.formatted(df).select(chatformat.learned_text(F.col("segments")).alias("t"), F.size(
        chatformat.read_back(chatformat.whole_text(F.col("segments")))).alias("n")).first()
    assert row.n == 5000 and row.t == "".join(f"<s>{k}" for k in range(1, 5000, 2))
