from corpusloom.llm import spam

PROSE = "The scanner reads every record it has seen. By default, the queue keeps the oldest entry until the next run starts. "
SPAM = {
    1: "best cheap script buy script download free script template buy cheap kit " * 20,
    2: "\n".join(f"- [buy script](https://a{n}.example/x{n * 7919})" for n in range(40)),
    3: "\n".join(f"Widget pro {n}.00 EUR - tags: buy, cheap, script, kit, best" for n in range(40)),
    4: " ".join(f"#scriptbuy #scriptfree {n}.99 USD" for n in range(60)),
    5: "script kaufen script günstig vorlage kostenlos script herunterladen " * 30,
}
FINE = {
    11: PROSE * 20,
    12: "\n".join(f"left-pad-{n}=={n}.2.1" for n in range(60)),
    13: "\n".join(f"  |-- src/module{n}/file.ts" for n in range(60)),
    14: "\n".join(f"2025-01-{n % 28 + 1:02}T04:11:07Z INFO worker retries job {n}" for n in range(60)),
    15: "\n".join(f"- The worker number {n} reads all of its records at once." for n in range(60)),
    16: "def f(x):\n    return x + 1\n\n" * 40,
    17: PROSE.replace(".", "").replace(",", "") * 10,
    18: None, 19: "", 20: "  \n ", 21: "请在检查之后再合并。因为队列太长，我们移动了模块。" * 10,
}


def test_spam_and_look_alikes(spark):
    rows = spark.createDataFrame([(k, t, 0.5) for k, t in (SPAM | FINE).items()] * 2, "doc_id long, text string, spam_share double")
    got = sorted(r.doc_id for r in spam.spam_pages(rows).collect())
    assert got == sorted(list(SPAM) * 2)


def test_empty_table_long_text_and_majority(spark):
    schema = "doc_id long, text string"
    assert spam.spam_pages(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(1, SPAM[1] * 300), (2, PROSE * 30 + SPAM[1]), (None, SPAM[1])], schema)
    assert {r.doc_id for r in spam.spam_pages(rows).collect()} == {1, None}


def test_blocks_hold_the_whole_text():
    for text in ("", "a" * 5000, "word " * 999, "line of text\n" * 321):
        assert "".join(spam.blocks(text)) == text


def test_links_below_a_sentence_and_keywords_with_function_words():
    links = "These are the places that the team reads of a day.\n" + "\n".join(f"https://host{n}.invalid/{n * 7919}/page-{n * 104729}" for n in range(20))
    keywords = "buy cheap script for download and best free kit " * 25
    for text in (links, keywords):
        share, sentences, _ = spam.spam_score(text)
        assert share >= spam.MOSTLY and sentences < 0.4
    linked = "\n".join(f"- The worker number {n} reads all of the records that it has, and then it waits for the next ones: https://h.invalid/a/b/{n * 7919}" for n in range(30))
    assert spam.spam_score(linked)[0] == 0


def test_sentences_made_of_keywords_and_function_words_around_them():
    stuffed = "Looking for lifitogo? Lifitogo crack lifitogo starter lifitogo! Get lifitogo key, lifitogo kit and lifitogo free here! Best lifitogo theme lifitogo pro. " * 8
    around = "the best shoes of the year and the best of the boots " * 15
    for text in (stuffed, around, "By default, the queue keeps the oldest entry.\n\n" + stuffed):
        share, sentences, _ = spam.spam_score(text)
        assert share >= spam.MOSTLY and sentences < 0.4
    for text in ("Das Modul liest die Konfiguration beim Start und prüft jede Zeile. " * 20, "モジュール bozepaku は起動時に設定を読み込みます。\n" * 20, "The cache keeps every page. The cache drops the page that nobody reads, and then it frees its lock. " * 12):
        assert spam.spam_score(text)[0] == 0


def test_usual_ratio_is_the_median_of_all_blocks_of_a_language(spark):
    rows = [(n, PROSE * 5, "en") for n in range(200)] + [(1000 + n, SPAM[1], "EN") for n in range(3)]
    pages = spam.page_blocks(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    usual = {(r.lang, r.dense): r.usual for r in spam.usual_ratios(pages).collect()}
    ratio = next(spam.block_features(PROSE * 5))[2]
    assert set(usual) == {("en", False)} and abs(usual["en", False] - max(spam.USUAL[0], (ratio * 209 + 50) / 259)) < 0.15
    assert spam.block_ratio(SPAM[1], False) < 0.5 < spam.block_ratio(PROSE, False)
