"""Figures against plain counting, and the line rules."""

import re

import pytest

from gleaner.llm import quality

TEXTS = [
    None, "", " \n\t", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 60, "a b c d e f g h i a b c d e f g h j a b",
    "line one.\nline one.\n\nline two.\r\nline one.", "A # b * | < > $5 100%", "menu\nA real sentence of seven words here.\nHome\nprivacy policy",
    "x\u00a0y z\u2003w é" * 9, "t\x0bu\x0cv\x1cw", "w" * 50_000, " ".join(f"w{i % 700}" for i in range(20_000)),
]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    where = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_figures(spark, documents):
    texts = TEXTS + [r.text for r in documents.collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.clean(df).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == plain(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.kept and r.base_failed)


@pytest.mark.parametrize(
    ("line", "fails"),
    [
        ("A whole sentence of several words stands here.", False), ("A whole sentence without an end stands here", True), ("Short title", False),
        ("Home", True), ("a | b | c | d.", True), ("We use cookies to do things for you.", True), ("All rights reserved.", True), ("if (x) { y }", True),
        ("", False), ("   ", False), ("He said: “It is all done now, is it?”", False), ("to%%% be### or*** not$$$ to&&& be.", True),
        ("यह एक पूरा वाक्य है जो यहाँ खड़ा है।", False), ("هل هذه جملة كاملة من عدة كلمات؟", False), ("這 是 一 個 完整 的 句子。", False), ("他 说 ： “ 这 是 句子 。”", False),
        ("यह एक पूरा वाक्य है जो यहाँ खड़ा", True), ("Write {name} where your own name should stand.", False), ("x = {", True), ("}", True), ("{ a: 1; }", True),
        ("Startseite", True), ("Alle Rechte vorbehalten.", True), ("Lire la suite", True), ("Todos los derechos reservados.", True), ("Die Suche nach dem Glück dauert an.", False),
    ],
)
def test_line_rules(spark, line, fails):
    df = spark.createDataFrame([(line,)], "text string")
    assert df.select(quality.line_fails(df.text)).first()[0] is fails


def test_texts_that_lose_too_much(spark):
    good = "This is a fine sentence with enough words in it.\n"
    bad = "one | two | three | four | five | six\n"
    different = "".join(f"Sentence number {i} has its own words {i} here.\n" for i in range(9))
    rows = [(1, different), (2, different + bad), (3, "".join(bad.replace("one", f"n{i}") for i in range(9)) + good)]
    got = {r.doc_id: r for r in quality.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[2].kept and not got[3].kept
    assert got[2].cleaned_text == different and got[2].lost_words == 11


def test_odd_rows(odd_documents, no_documents):
    got = quality.clean(odd_documents)
    assert got.count() == odd_documents.count() and got.where("words = 'mine words'").count() == odd_documents.count()
    assert quality.clean(no_documents).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_documents_of_other_scripts_are_kept(spark):
    lines = ["यह पंक्ति {0} अपने शब्दों के {0} साथ एक पूरा वाक्य है।", "هذه الجملة {0} كاملة ولها {0} كلمات خاصة بها هنا۔", "第 {0} 行 是 一 個 {0} 完整 的 句子 而且 不同。"]
    rows = [(i, "\n".join(line.format(f"n{k} m{k * 7}") for k in range(9))) for i, line in enumerate(lines)]
    got = quality.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.kept, r.lost_words) for r in got] == [(True, 0)] * 3
