"""Counts against plain Python, host verdicts, and a plan without Python."""

import re

import pytest
from cartwright.llm import host_rules
from frames import documents, odd_rows, prose


def counted(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + j for spots in windows.values() if len(spots) > 1 for i in spots for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    )


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_counts(spark):
    rows = [*odd_rows(), (30, "line\n line\nline\n\n \nline", "en", "a"), (31, f"{prose(1, 9)} {prose(1, 9)} # $x <b>", "en", "a"),
            (32, f"{prose(2, 30)} {prose(3, 8)} {prose(4, 30)} {prose(3, 8)}", "en", "a")]
    docs = documents(spark, rows).withColumnsRenamed({"lang": "windows", "n_chars": "hashes"})
    found = host_rules.judged(docs).collect()
    assert sorted(str((r["doc_id"], *(r[n] for n in NAMES))) for r in found) == sorted(str((r[0], *counted(r[1]))) for r in rows)
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])


def test_hosts(spark):
    good, bad = prose(1, 50), "short"
    rows = [(i, bad if i % 20 else good, "en", "spam") for i in range(400)]
    rows += [(1000 + i, good if i % 10 else bad, "en", "fine") for i in range(400)]
    rows += [(2000, bad, "en", "new"), (2001, good, "en", None)]
    found = {r["doc_id"]: r for r in host_rules.judged(documents(spark, rows)).collect()}
    assert not any(found[i]["kept"] for i in range(400))
    assert [found[1000 + i]["kept"] for i in range(400)] == [i % 10 != 0 for i in range(400)]
    assert 0.3 < found[2000]["host_rate"] < 1 and found[2001]["host_rate"] < found[2000]["host_rate"]
    assert found[0]["host_rate"] == pytest.approx(0.95, abs=0.02)


def test_a_long_text_of_one_word(spark):
    rows = [(1, "again " * 200_000, "en", "a")]
    assert host_rules.judged(documents(spark, rows)).first()["n_repeat_words"] == 200_000


def test_empty_table_and_no_python(spark, capsys):
    assert host_rules.judged(documents(spark, [])).count() == 0
    host_rules.counts(documents(spark, odd_rows())).explain()
    plan = capsys.readouterr().out
    assert "Project" in plan and not re.search("Python|Pandas|Arrow", plan)
