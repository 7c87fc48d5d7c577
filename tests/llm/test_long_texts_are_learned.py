"""Languages whose texts are all long."""

import random

from bracken.llm import langid


def test_a_language_of_long_texts_alone_is_learned(spark):
    rnd = random.Random(1)
    text = lambda letters, n: "".join(rnd.choices(letters + "  ", k=n))
    rows = [(i, "9" * 25_000 + text("abcde", 30_000), "long") for i in range(8)] + [(i, text("vwxyz", 300), "short") for i in range(100, 130)] + [(i, "123 !?", "bare") for i in range(200, 210)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = langid.sample(df)
    assert set(langs) == {"long", "short"} and max(map(len, texts)) == langid.LONGEST
    got = langid.identified(df, langid.fit(texts, langs)).collect()
    lang = {d: name for d, _, name in rows}
    assert all(r.lang_pred == ("und" if lang[r.doc_id] == "bare" else lang[r.doc_id]) for r in got)
