import pytest

from glyphmill.functions import text as X
from glyphmill.operators import characters, decisions, fixes, lexical, structure
from glyphmill.plans import registry, seed
from glyphmill.sources import files
from glyphmill.streaming.scan import stream_issues
from pyspark.sql import functions as F


UNCHECKED = {
    *["foreign_scopes", "markdown_mask", "table_cells", "cell_issues", "section_starts", "masked_scan", "convert_fixpoint", "quotation_marks", "style_findings"],
    *["section_endings", "excessive_bold", "repeated_slogans", "self_questions", "uncited_attributions", "long_premodifiers", "word_tokens", "confirmed_clues"],
    *["placed_issues", "issue_chunks", "machine_scores", "style_scorecard", "quality_flags", "checked_call", "sentence_places", "whole_scan"],
}


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def found(spark, *texts):
    rules = lexical.merged(seed.rules(spark))
    return sorted((r.doc_id, r.pos, r.found, tuple(r.suggestions)) for r in lexical.issues(docs_of(spark, *texts), rules).collect())


def test_longest_match_wins(spark):
    assert found(spark, "數據庫和數據") == [(0, 0, "數據庫", ("資料庫",)), (0, 4, "數據", ("資料",))]


def test_clues_and_negative_clues(spark):
    assert found(spark, "打開文件", "讀文件", "物理的質量", "質量好", "打印\n\n程序", None, "") == [(0, 2, "文件", ("檔案", "文件")), (3, 0, "質量", ("品質",)), (4, 0, "打印", ("列印",))]


def test_later_layers_replace_and_disable(spark):
    rules = {r["from"]: r["to"] for r in lexical.merged(seed.rules(spark)).collect()}
    assert rules["圖像"] == ["圖片"] and "項目" not in rules
    assert [tuple(r) for r in lexical.conflicts(seed.rules(spark)).collect()] == [("圖像", 0, 12, 1, 1)]


def test_offsets_in_three_units(spark):
    docs = docs_of(spark, "a𠀀\n𠀀軟件")
    row = lexical.issues(docs, lexical.merged(seed.rules(spark))).first()
    assert (row.pos, row.byte_offset, row.line, row.col) == (4, 10, 2, 3)


def test_fix_is_stable(spark):
    scanner = lexical.scanner(seed.rules(spark))
    docs = docs_of(spark, "數據庫的信息和文件", "沒有", None)
    once = fixes.fixed(docs, scanner)
    assert sorted((r.doc_id, r.text, r.n_applied) for r in once.collect()) == [(0, "資料庫的資訊和文件", 2), (1, "沒有", 0), (2, None, 0)]
    again = once.select("doc_id", "text")
    assert {r.text for r in fixes.fixed(again, scanner).collect()} == {"沒有", "資料庫的資訊和文件", None}


def test_rows_that_share_an_id_are_texts_of_their_own(spark):
    docs = spark.createDataFrame([(1, "軟件"), (1, "信息很多軟件"), (None, "軟件"), (1, "軟件")], "doc_id long, text string")
    rules = seed.rules(spark)
    got = sorted(((r.doc_id, r.pos, r.found) for r in lexical.issues(docs, rules).collect()), key=repr)
    assert got == sorted([(1, 0, "軟件"), (1, 0, "信息"), (1, 4, "軟件"), (None, 0, "軟件"), (1, 0, "軟件")], key=repr)
    assert sorted(r.text for r in fixes.fixed(docs, lexical.scanner(rules)).collect()) == ["資訊很多軟體", "軟體", "軟體", "軟體"]


def test_time_is_linear_in_the_text(spark):
    import time

    scanner = lexical.scanner(seed.rules(spark))
    took = []
    for n in (20_000, 160_000):
        text = "這個軟件的信息很多。\n" * (n // 11)
        begun = time.perf_counter()
        assert len(scanner.scan(text)) == 2 * (n // 11)
        took.append(time.perf_counter() - begun)
    assert took[1] < 8 * 3 * took[0]


def test_union_of_spans(spark):
    spans = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (1, 7, 9), (1, 1, 2), (2, 4, 5)], "doc_id long, start int, end int")
    assert sorted((r.doc_id, r.start, r.end) for r in lexical.union_of(spans).collect()) == [(1, 0, 5), (1, 7, 9), (2, 4, 5)]


@pytest.mark.parametrize(
    "detector,good,bad,n",
    [
        (characters.half_width_marks, "數 1,000 a, b", "你好, 世界!", 2),
        (characters.missing_spaces, "用 GPU 算", "用GPU算3次", 4),
        (characters.repeated_marks, "好……——！", "好。。真的！！", 2),
        (characters.repeated_units, "哈哈 研究", "研究研究事情事情", 2),
    ],
)
def test_character_detectors(spark, detector, good, bad, n):
    got = [r.doc_id for r in detector(docs_of(spark, good, bad)).collect()]
    assert got.count(0) == 0 and got.count(1) == n


def test_structure_detectors(spark):
    assert [r.n_repeats for r in structure.latin_repetitions(docs_of(spark, "the The cat cat sat\nsat no no", "a a bb bb")).collect()] == [3]
    assert [r.doc_id for r in structure.mixed_address(docs_of(spark, "你好您您", "你好")).collect()] == [0]
    assert [r.n_sentences for r in structure.pronoun_runs(docs_of(spark, "我來。他走。她笑。天晴。我哭。")).collect()] == [3]
    assert [r.n_segments for r in structure.comma_runs(docs_of(spark, "有，甲，乙，丙丁，好的")).collect()] == [3]
    assert [r.found for r in structure.spaced_acronyms(docs_of(spark, "用C P U算 A B c", "A man")).collect()] == ["C P U"]


def test_script(spark):
    got = [r.s for r in docs_of(spark, "他们说", "他們說", "好", " ").select(X.script(F.col("text")).alias("s")).collect()]
    assert got == ["simplified", "traditional", "unknown", "unknown"]


def test_memory_takes_the_last_word(spark):
    memory = spark.createDataFrame([("a", "b", "1"), ("a", "a", "2"), ("c", "c", "1"), ("c", "d", "2")], "found string, user_chose string, timestamp string")
    assert {(r.found, r.user_chose) for r in decisions.latest_decisions(memory).collect()} == {("a", "a"), ("c", "d")}


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in" / ".hidden").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("軟件")
    (tmp_path / "in" / "b.txt").write_text("x")
    (tmp_path / "in" / "c.bin").write_text("x")
    (tmp_path / "in" / ".hidden" / "d.md").write_text("x")
    got = {r.path.rsplit("/", 1)[1]: r.content_type for r in files.scan_files(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.md": "markdown", "b.txt": "plain"}
    docs_of(spark, "軟件").write.parquet(str(tmp_path / "arriving"))
    query = stream_issues(spark, str(tmp_path / "arriving"), lexical.merged(seed.rules(spark)), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    assert [r.found for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["軟件"]


def test_every_query_runs(spark, sf):
    # state machines, which SQL can't express; tests hold them against brute force or worked examples
    unchecked = set(registry.queries()) - set(registry.oracle_sql())
    assert unchecked == UNCHECKED and set(registry.oracle_sql()) < set(registry.queries())
    for name in unchecked:
        assert registry.queries()[name](spark, sf).count() > 0, name
    assert registry.flagship(spark, sf).count() > 0


def test_banned_terms_that_no_rule_finds(spark):
    from glyphmill.operators import decisions

    docs = spark.createDataFrame([(1, "好視頻\n壞東西壞"), (2, "沒有")], "doc_id long, text string")
    issues = spark.createDataFrame([(1, 1, "視頻", "warning")], "doc_id long, pos int, found string, severity string")
    terms = spark.createDataFrame([("視", "banned"), ("壞", "banned")], "term string, kind string")
    got = sorted(map(tuple, decisions.with_glossary(issues, terms, docs).select("doc_id", "pos", "found", "severity").collect()))
    assert got == [(1, 1, "視頻", "error"), (1, 4, "壞", "error"), (1, 7, "壞", "error")]
