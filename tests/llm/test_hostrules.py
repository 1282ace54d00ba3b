import re
from collections import Counter

from tallyloom.llm import hostrules


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(again))


TEXTS = [None, "", "\n \n", "a b c d e a b c d e f", "x " * 3000, "one\ntwo\none\n\none ", "é𝄞 ## <b>", "k " * 4,
         " ".join(f"w{k % 90}" for k in range(400)), "a\x0bb\x0cc\rd\te f\x85g"]


def test_measures_equal_brute_force(spark):
    docs = spark.createDataFrame([(k, t, "h") for k, t in enumerate(TEXTS)], "doc_id long, text string, source string")
    for row in hostrules.measured(docs).collect():
        m = row.m
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == brute(row.doc.text), row.doc.text


def clean(k):
    return " ".join(f"word{(k * 31 + j) % 977}" for j in range(40))


def test_bad_hosts_lose_failing_documents_only(spark):
    noisy = " ".join("#$ ab%" for _ in range(12)) + " plain words that do not come twice"
    rows = [(k, clean(k), "good") for k in range(40)] + [(100, noisy, "good"), (101, "too short", "good")]
    rows += [(200 + k, noisy + f" {k}", "bad") for k in range(60)] + [(300, clean(7), "bad")]
    rows += [(400, noisy, None), (401, clean(3), None), (402, None, "one"), (403, clean(3), None), (403, clean(3), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.selectExpr("*", "'x' AS host", "1 AS m", "true AS kept", "0 AS doc", "2 AS bad")
    verdicts = {r.host: r.rejected for r in hostrules.host_verdicts(hostrules.measured(docs)).collect()}
    assert verdicts["bad"] and not verdicts["good"] and not verdicts[None]
    kept = hostrules.keep_good(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == [*range(40), 300, 401, 403, 403] + ([] if brute(noisy)[4] * 5 > brute(noisy)[0] else [])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert hostrules.keep_good(docs).count() == 0


def test_prior_pulls_small_hosts(spark):
    rows = [("a", 0)] * 90 + [("a", 1)] * 10 + [("b", 0)] * 85 + [("b", 1)] * 15 + [("tiny", 1)]
    found = {r.host: r.rate for r in hostrules.host_verdicts(
        spark.createDataFrame(rows, "host string, n_failed long")).collect()}
    assert 0.1 < found["tiny"] < 0.95 and abs(found["a"] - 0.1) < 0.03


def test_host_far_worse_than_its_peers_is_rejected(spark):
    """A planted host with two failures in five documents, among hosts with one in fifteen; its clean documents stay."""
    rows = [(f"h{h}", int(k % 15 == h % 15)) for h in range(20) for k in range(60)] + [("planted", int(k % 5 < 2)) for k in range(60)]
    rows += [("few", 1)] * 2 + [("hot", int(k % 15 == 0)) for k in range(900)]
    found = hostrules.host_verdicts(spark.createDataFrame(rows, "host string, n_failed long")).collect()
    assert {r.host for r in found if r.rejected} == {"planted"}


def test_hosts_that_all_fail_or_all_pass(spark):
    for n in (0, 1):
        rows = spark.createDataFrame([(h, n) for h in "abc" for _ in range(9)], "host string, n_failed long")
        assert [r.rejected for r in hostrules.host_verdicts(rows).collect()] == [False] * 3


def test_very_long_text(spark):
    text = " ".join(f"w{k % 50_021}" for k in range(60_000)) + "\n"
    docs = spark.createDataFrame([(1, text * 2, "h")], "doc_id long, text string, source string")
    m = hostrules.measured(docs).first().m
    assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == brute(text * 2)
