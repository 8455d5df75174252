from collections import Counter

from rosterlake.llm import rules
from tests.llm.common import ODD, docs, prose

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base(text):
    text = text or ""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        n < 10 or 100 * len(covered) > 20 * n,
    )


CASES = [
    (20, prose(1, 200)),
    (21, "same line again.\n" * 12),
    (22, "a b c d e f g h i j. a b c d e x y. z a b c d e " + prose(2, 60)),
    (23, "Home | About | News | Contact | Help | Terms | Jobs | More | Press | Blog | Shop"),
    (24, prose(3, 60) + "\nAll rights reserved. See our cookie policy."),
    (25, " ".join(w + "%%%" for w in prose(4, 80).split())),
    (26, "EVERY!! WORD!! SHOUTS!! AT!! YOU!! IN!! THIS!! LINE!! OF!! TEXT!! HERE!!"),
    (27, "é ü x \x1c y\x0bz \x85 " + prose(5, 30)),
    (28, "no end of a sentence anywhere in this line of more than ten words\n" + prose(6, 100)),
    (29, "q" * 70000 + " " + prose(8, 5000)),
]


def test_counts_equal_brute_force(spark):
    rows = ODD + CASES
    got = rules.judge_lines(docs(spark, rows)).select("doc_id", "text", "rules.*").collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[n] for n in NAMES) == base(r.text), r.doc_id
        assert not (r.kept and r.base_failed)
    kept = {r.doc_id: r.kept for r in got}
    assert [kept[i] for i in range(20, 29)] == [True, False, True, False, True, False, False, True, True]
    cleaned = {r.doc_id: r.cleaned for r in got}
    assert "cookie" not in cleaned[24] and cleaned[20] == "\n".join(x for x in CASES[0][1].split("\n") if x.strip())
    assert "no end" not in cleaned[28]


def test_kept_documents_have_the_same_columns(spark):
    given = docs(spark, CASES + ODD)
    kept = rules.kept_documents(given)
    assert kept.columns == given.columns
    assert sorted(r.doc_id for r in kept.collect()) == [20, 22, 24, 27, 28, 29]
    counted = rules.kept_documents(spark.createDataFrame([(1, prose(1, 50) + "\nx y", 5)], "doc_id int, text string, n_chars bigint"))
    assert [r.n_chars == len(r.text) for r in counted.collect()] == [True]
    assert rules.kept_documents(docs(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = rules.kept_documents(docs(spark, CASES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_columns_named_like_inner_ones(spark):
    names = ["doc_id", "text", "_rules_text", "rules_text", "rules__words", "verdict", "Verdict_x", "n_chars"]
    rows = [(1, "A good line of prose stands here, long enough to be kept.\nmenu | about | contact | home |", "a", "b", "c", "d", "e", 7), (2, None, "a", "b", "c", "d", "e", 0)]
    kept = rules.kept_documents(spark.createDataFrame(rows, "doc_id int, text string, _rules_text string, rules_text string, rules__words string, verdict string, Verdict_x string, n_chars int"))
    assert kept.columns == names
    assert [tuple(r) for r in kept.collect()] == [(1, "A good line of prose stands here, long enough to be kept.", "a", "b", "c", "d", "e", 57)]
