from pyspark.sql import functions as F

from bracken.functions import profiles as P
from bracken.functions import structured as S
from bracken.functions import text as T


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()[0]


def check(spark, cases, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], f"i int, x {kind}")
    got = [r[0] for r in rows.orderBy("i").select(make(F.col("x"))).collect()]
    assert got == [e for _, e in cases]


def test_front_matter_kinds(spark):
    check(spark, [("", "fragment"), ("短" * 19, "fragment"), ("正文" * 20, ""), ("图书在版编目" + "字" * 30, "copyright"), ("责任编辑 某人 " + "字" * 30, "publication_fragment"), ("责任编辑 某人 封面设计 " + "字" * 200, "copyright"), ("第一章 …… 1\n第二章 …… 2\n第三章 …… 3\n" + "字" * 20, "toc"), ("第一章 …… 1\n第二章 …… 2\n" + "字" * 20, ""), ("定价 30 元" + "字" * 100, "")], T.front_matter_kind)


def test_clean_chunk_keeps_a_body(spark):
    body = "这是一个句子，说了一些事情。" * 20
    text = body + "\n版权所有 某出版社\n统筹监制 某人"
    kept = one(spark, text, T.clean_chunk(F.col("x"))[0])
    assert kept == body
    assert one(spark, "ISBN 978 " + "字" * 300, T.clean_chunk(F.col("x"))[0]) == ""


def test_noise_lines(spark):
    check(spark, [("", True), (" 12 ", True), ("— 12 —", True), ("2020.12.1", True), ("***", True), ("版权所有 某社", True), ("正文里的一句话。", False), ("Playinart制作", True), ("1234567", False)], T.is_ocr_noise)
    check(spark, [("欢迎加入我们", True), ("UnTitled1150019", True), ("第 3 页", True), ("正文", False)], T.is_vision_noise)


def test_toc_page_needs_five_lines(spark):
    check(spark, [(["a 1", "b 2", "c 3", "d", "e"], True), (["a 1", "b 2", "d", "e", "f"], False), (["a 1"] * 4, False)], T.is_toc_page, "array<string>")


def test_tokens_and_keys(spark):
    check(spark, [("荣格 Jung's理论", ["荣", "格", "Jung's", "理", "论"]), (None, [])], T.index_tokens)
    check(spark, [("  Ab　c-荣 格!", "abc荣格")], T.entity_key)


def test_sentences(spark):
    check(spark, [("一。二！三？四.五\n六", ["一。", "二！", "三？", "四.", "五", "六"]), (" \n ", [])], T.sentences)


def test_continuation(spark):
    check(spark, [("我们恐", True), ("我们恐怕。", False), ("————————", False), ("", False), ("abc  ", True)], T.needs_continuation)
    row = spark.createDataFrame([("我们恐", "书.pdf", " 怕。"), ("我们恐", "a.md", "怕。"), ("完了。", "b.pdf", "x")], "t string, s string, c string")
    got = [r[0] for r in row.select(T.with_continuation(F.col("t"), F.col("s"), F.col("c"))[0]).collect()]
    assert got == ["我们恐\n怕。", "我们恐", "完了。"]


def test_titles(spark):
    check(spark, [("红书（扫描版）", "红书"), ("红书_文字版.txt", "红书"), ("心理类型 第3版pdf", "心理类型"), ("知行合一王阳明(1427-1529)", "知行合一王阳明"), ("书名2", "书名2"), ("红书上册", "红书")], T.normalise_title)


def test_scores(spark):
    check(spark, [("4", 4), ("4分", 4), ("4/5", 4), ("4/10", None), ("4.0", 4), ("4.5", None), ("true", None), ("0", None), ("6", None), (None, None)], T.score)


def test_triples(spark):
    got = spark.createDataFrame([("a|person|likes|b|Concept|e|v",), ("a|likes|b|e|v",), ("a|likes|A |x",), ("a|b",)], "x string").select(T.triple(F.col("x")).alias("t")).collect()
    assert got[0].t.asDict() == {"h": "a", "ht": "person", "r": "likes", "t": "b", "tt": "concept", "e": "e|v"}
    assert got[1].t.asDict() == {"h": "a", "ht": "", "r": "likes", "t": "b", "tt": "", "e": "e|v"}
    assert got[2].t is None and got[3].t is None


def test_coercion_masking_dpi(spark):
    check(spark, [("3", 3.0), ("true", None), ("nan", None), ("Infinity", None), ("", None), ("2e9", 1e6), (None, None)], T.coerced_number)
    check(spark, [("sk-1234567890", "sk-1****7890"), ("short", "****"), (None, "")], T.masked)
    check(spark, [(800.0, 300), (8000.0, 72), (30000.0, None)], T.dpi, "double")


def test_lines_join_without_spaces_in_chinese(spark):
    check(spark, [(["你", "好", "hello", "world"], "你好hello world")], T.joined_lines, "array<string>")


def test_banned(spark):
    check(spark, [("如何洗钱", P.REFUSAL), ("你好", "你好"), (None, None)], T.refused)


def test_json():
    assert S.loose_object('x ```json\n{"a": 1}\n``` y') == {"a": 1}
    assert S.loose_object('well {"a": "}"} and') == {"a": "}"}
    assert S.loose_object("none") is None
    fields = {"want": bool, "urgency": int, "reason": str}
    assert S.strict_object('{"want": true, "urgency": 3}', fields)[1] is None
    assert S.strict_object('{"want": 1}', fields)[1] == "type of want"
    assert S.strict_object('{"urgency": true}', fields)[1] == "type of urgency"
    assert S.strict_object('{"want": true, "want": false}', fields)[1] == "duplicate key"
    assert S.strict_object('{"urgency": NaN}', fields)[1] == "constant NaN"
    assert S.strict_object('{"x": 1}', fields)[1] == "unknown field x"
    assert S.strict_object("[1]", fields)[1] == "not an object"


def test_summary_slots_and_messages(spark):
    check(spark, [("2: b\n1：a \n2: c\n9: z", ["a", "b", ""])], lambda c: S.summary_slots(c, 3))
    rows = spark.createDataFrame([(1, "query", 0, "q"), (1, "persona", 0, "p"), (1, "history", 1, "h2"), (1, "history", 0, "h1"), (1, "memory", 0, "")], "request int, part string, pos int, text string")
    assert S.messages(rows).first().asDict() == {"request": 1, "text": "p\n\nh1\n\nh2\n\nq", "chars": 6}
