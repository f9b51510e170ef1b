import re

import pytest

from closura.llm import quality
from closura.llm.queries import QUERIES

COLS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def test_base_equals_brute_force_and_junk_goes(spark, sf):
    got = {r["doc_id"]: r for r in QUERIES["op8_quality_rules"](spark, sf).collect()}
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        want = brute(text)
        assert tuple(got[i][c] for c in COLS) == want
        assert got[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (got[i]["kept"] and got[i]["base_failed"])
        if want[0] >= 20 and want[2] >= want[0]:  # a symbol for every word
            assert not got[i]["kept"]


def test_odd_rows(spark):
    loop = "a b c d e f g h " * 5
    rows = [
        (1, None, "en", "s"), (2, "", None, None), (3, "  \n\t ", "en", None), (4, loop, "en", "s"), (4, loop, "en", "s"),
        (None, "one two\none two\n\n\n", "en", "s"), (6, "wörd " * 50_000, "de", "s"), (7, "x\x0by\x0cz é f", "en", "s"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_words string, kept string"
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], schema)
    got = quality.judge(docs).collect()
    want = sorted((str(r[0]), *brute(r[1])) for r in rows)
    assert sorted((str(r["doc_id"]), *(r[c] for c in COLS)) for r in got) == want
    assert quality.judge(docs.limit(0)).collect() == []


@pytest.mark.parametrize("few", [1, 10**9])
def test_thresholds_follow_their_group(spark, few):
    """Half of a source may be junk: the fence stays near its clean half."""
    words = lambda n, mark: " ".join(f"w{i}{mark}" for i in range(n))
    rows = [(i, words(40 + i % 7, "%%" if i % 3 == 0 else ""), "en", f"s{i % 2}") for i in range(300)]
    rows += [(1000 + i, words(60, "#"), "xx", "code") for i in range(300)]  # symbols are usual here
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, few=few).collect()}
    assert all(got[i] == (i % 3 != 0) for i in range(300))
    assert all(got[1000 + i] for i in range(300))


def test_cutoffs_move_smoothly_with_the_size_of_a_group(spark):
    """One document more never moves a cutoff by more than its share."""
    words = lambda n, mark: " ".join(f"w{i}{mark}" for i in range(n))
    plain = [(i, words(40 + i % 7, ""), "en", "a") for i in range(400)]
    before = None
    for n in (49, 50, 51, 199, 200, 201):
        rows = plain + [(1000 + i, words(60, "%"), "en", "b") for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        cuts = quality.thresholds(quality.with_shares(quality.measure(docs))).where("source = 'b'").first()
        if before is not None and n - before[0] == 1:
            assert abs(cuts["symbols_per_word_high"] - before[1]) < 0.1 and abs(cuts["mean_chars_high"] - before[2]) < 0.2
        before = (n, cuts["symbols_per_word_high"], cuts["mean_chars_high"])
