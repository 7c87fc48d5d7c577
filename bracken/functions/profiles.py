"""Parameters of the text operators: word lists, patterns, weights. Patterns are in the common subset of Java and RE2."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FrontMatter:
    """Patterns and thresholds of the front-matter filter."""

    strong: str
    publishing: str
    boilerplate: str
    toc_line: str
    toc_head: str
    sentence_end: str
    min_useful: int = 200
    min_any: int = 20
    min_density: float = 1.0


# The Chinese profile's word lists and patterns must equal those of the corpora it was made for.
CHINESE = FrontMatter(
    strong="ISBN|图书在版编目|CIP\\s*数据|版权所有|出版发行",
    publishing="定价|开本|印张|印次|责任编辑|封面设计|装帧设计|书号|出版时间|出版社",
    boilerplate="统筹监制|特约编辑|责任编辑|封面设计|装帧设计|市场推广|限量版|珍藏版|丛书主编|出品人|策划编辑|出版公司|出版发行",
    toc_line="(?m)(?:\\.{4,}|…{2,}|·{4,}|-{6,})[\\s\\d]*\\d{1,4}\\s*$",
    toc_head="^\\s*(?:目\\s*录|第[〇一二三四五六七八九十百零两\\d]{1,4}[讲章节篇部卷回]|[一二三四五六七八九十]{1,3}、)\\s*\\S",
    sentence_end="[。！？!?；;]",
)

#: For text in Latin script, where licence lines take the part of the copyright page.
LATIN = FrontMatter(
    strong="ISBN|Licensed under|All rights reserved",
    publishing="Publisher|Edition|Released under",
    boilerplate="General Public License|MIT License|CC BY|version [0-9]",
    toc_line="(?m)(?:\\.{4,}|-{6,}|\\|)[\\s\\d]*\\d{1,4}\\s*$",
    toc_head="^\\s*(?:Chapter|Contents|[IVX]{1,4}\\.)\\s*\\S",
    sentence_end="[.!?;]",
)

# Patterns of publication data in short lines, white space removed.
OCR_NOISE = (
    "版权信息", "版权所有", "图书在版编目", "版本图书馆", "CIP", "ISBN", "书名[:：]", "出版发行[:：]", "出版人[:：]", "出版社", "印刷", "定价[:：]",
    "开本", "字数", "印张", "印次", "策划编辑", "责任编辑", "装帧设计", "封面设计", "电子邮箱", "邮购电话", "目录[:：]", "^[A-Za-z0-9]+制作$",
)

# Watermarks and placeholders of digitised books.
VISION_NOISE = (
    "欢迎加入", "一个分享阅读体验和求书找书的平台", "As a reader", "UnTitled\\d*", "书名\\s*[=＝]", "各类\\s*PDF\\s*电子书", "电子书\\s*下载", "最新电子书",
    "免费分享社", "免费分享\\s*[:：]?", "仅供.{0,4}(?:试读|学习|交流)", "请支持正版", "侵权.{0,4}联系", "本文档由.{0,10}(?:整理|制作|扫描)", "扫描全能版", "^\\s*第?\\s*\\d+\\s*页?\\s*$",
)

# Terms that are refused, and the refusal.
BANNED = ("制作炸弹", "枪支", "冰毒", "海洛因", "买卖器官", "洗钱", "赌博网站", "开盒", "人肉搜索", "诈骗话术", "恐怖袭击", "邪教", "传销拉人")
REFUSAL = "这个话题我不太方便聊，咱们换个话题吧。"

# Characters that mark doubly decoded Chinese text, and where it counts as such.
MOJIBAKE_MARKS = "锛嬨晲鐨勬櫤閲戝殑鑷绔鑻鏄庣瓧绗鍙戠幇"
MOJIBAKE_RATIO = 0.02
MOJIBAKE_CHARS = 3000

# Weights of source types in fusion.
SOURCE_WEIGHTS = {"anchor": 2.0, "oral": 1.5, "original": 1.2, "artificial": 0.6, "secondary": 0.25, "unknown": 1.0}

#: Rules (part of the source's name, type) in order; these suit tables whose sources are src0, src1, ...
SOURCE_RULES = (("src19", "anchor"), ("src1", "original"), ("src2", "oral"), ("src5", "artificial"), ("src7", "secondary"))

# What is taken off the end of a book's file name, again and again.
TITLE_TAIL = "txt|pdf|text|文字版|电子书|扫描版|高清|全本|完整版|上下册?|上册|中册|下册|dk|zb|第\\d+版|新版|修订版?|精校版?|无删减|word|doc|epub|mobi"
TITLE_BRACKETS = "[（(\\[【《].*?[)）\\]】》]"
TITLE_PUNCTUATION = "[\\s_\\-—－·。，,、：:；;！!？?\"“”'‘’#]+"

# Ends of sentences, for cutting, for stitching and for the continuation of a chunk.
SENTENCE_CUT = "。！？.!?"
STITCH_ENDS = "。！？!?…"
TAIL_ENDS = "。！？…"

# Patterns of lines without text of their own, and of blocks in result pages.
NUMBER_LINE = r"^\d{1,6}$"
FRAMED_NUMBER = r"^[~～\-—·*※＝=]+\d{1,4}[~～\-—·*※＝=]+$"
DATE_LINE = r"^\d{2,4}[./]\d{1,2}(?:[./]\d{1,2})?$"
RESULT_BLOCKS = (
    r'(?is)<li[^>]*class="[^"]*b_algo[^"]*"[^>]*>.*?</li>', r'(?is)<div[^>]*class="[^"]*c-abstract[^"]*"[^>]*>.*?</div>', r'(?is)<td[^>]*class="[^"]*result-snippet[^"]*"[^>]*>.*?</td>',
)
PARAGRAPH = r"(?is)<p[^>]*>(.*?)</p>"

# Verdicts of a graph's audit, empty batches that stop a build, margins and headings of a page, caps of a
# meeting's summary, words that it must not have, and what closes it instead; the cosine of a cached question.
VERDICTS = ("faithful", "unsupported", "unclear", "unknown")
EMPTY_ABORT = 5
MARGIN_RATIO, MARGIN_CHARS, HEADING_CHARS = 0.06, 30, 45
SUMMARY_CLASHES, SUMMARY_OPEN, SUMMARY_APPLICATIONS, SUMMARY_CHARS, CLOSING_CHARS, STANCE_CHARS = 6, 3, 3, 300, 800, 60
SUMMARY_BANNED = ("更有说服力", "更有道理", "更占理", "更站得住脚", "站不住脚", "略胜", "更胜", "胜出", "获胜", "胜者", "谁赢", "赢了", "所有观点都正确", "所有观点都同样正确", "每种观点都正确")
CLOSING = "本场发言已结束，各方主张分别保留。讨论结束不代表达成一致；具体采用哪种观点，需要结合问题的条件判断。"
CACHE_SIMILAR = 0.92

# Constants of scoring, chunking, depths, graphs, memories and limits.
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
CHUNK_MAX, CHUNK_MIN, CHUNK_OVERLAP = 1000, 500, 100
POOL, ANCHOR, TOP_STRONG, TOP_LIGHT = 10, 3, 6, 3
GRAPH_SEEDS, GRAPH_MIN_NAME, GRAPH_EDGES, GRAPH_SUPPORT, GRAPH_CONTEXT = 6, 2, 30, 2, 2200
MEMORY_CAPS = {"profile": 8, "topic": 40}
MEMORY_TOP_PROFILES, MEMORY_TOP_TOPICS, MEMORY_SIMILAR, MEMORY_REPLACE = 5, 3, 0.55, 0.85
LIMIT_MINUTE, LIMIT_DAY, LIMIT_GLOBAL = 10, 300, 120
