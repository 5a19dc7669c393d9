import re

from leafscan.llm import rules

from .helpers import no_docs, odd_docs, odd_rows


def counts(text):
    text = text or ""
    each = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(each[i : i + 5]) for i in range(len(each) - 4)]
    covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)} if len(grams) < 500 else set()
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return len(each), sum(map(len, each)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_a_loop(spark):
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rules.quality(odd_docs(spark)).collect()}
    assert got == {(i, *counts(t)) for i, t, *_ in odd_rows()}


def test_verdicts(spark):
    clean = "The cat sat on the mat and it was warm in the sun by the old door.\nAll was well with them that day."
    rows = [(1, clean), (2, "a b c d e " * 6), (3, "# " * 30 + clean), (4, "x" * 400 + " " + "y" * 300 + " q w e r t y u i o p"), (5, "one line of text here\n" * 9 + "of the end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in rules.quality(df).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False), 4: (False, False), 5: (True, False)}


def test_threshold_table_is_compiled(spark):
    df = spark.createDataFrame([(1, "one two three four five six seven eight nine ten of the")], "doc_id long, text string")
    one = lambda r: rules.quality(df, (r,)).first()["kept"]
    assert one(rules.Rule("r", "n_words", low=12)) and not one(rules.Rule("r", "n_words", low=13)) and not one(rules.Rule("r", "n_words", high=11))
    assert one(rules.Rule("r", "n_words", high=11, from_words=20))


def test_empty_table_and_plan(spark):
    out = rules.quality(no_docs(spark))
    assert out.count() == 0
    plan = rules.quality(odd_docs(spark))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan
