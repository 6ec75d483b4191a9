"""Answer metrics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks that do not count.
PUNCTUATION = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
CJK_PUNCTUATION = "[！？｡。＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～｟｠｢｣､、〃》「」『』【】〔〕〖〗〘〙〚〛〜〝〞〟〰〾〿–—‘’‛“”„‟…‧﹏.]"


def normalize_answer(s: Column) -> Column:
    t = F.regexp_replace(F.lower(s), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " "), r"\s+", " "))


def normalize_zh_answer(s: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.lower(s), PUNCTUATION, ""), CJK_PUNCTUATION, "")
    return F.regexp_replace(t, r"\s+", "")


def tokens(s: Column) -> Column:
    return F.filter(F.split(s, r"\s+"), lambda x: x != "")


def count_score(prediction: Column, truth: Column) -> Column:
    """Share of the prediction's numbers that equal the truth; 0 without numbers."""
    n = F.regexp_extract_all(prediction, F.lit(r"\d+"), F.lit(0))
    return F.when(F.size(n) > 0, F.size(F.filter(n, lambda x: x == truth)) / F.size(n)).otherwise(F.lit(0.0))


def retrieval_score(prediction: Column, truth: Column, pattern: str = r"Paragraph (\d+)") -> Column:
    return count_score(prediction, F.regexp_extract(truth, pattern, 1))


def retrieval_zh_score(prediction: Column, truth: Column) -> Column:
    return retrieval_score(prediction, truth, r"段落(\d+)")


def classification_score(prediction: Column, truth: Column, classes: Column) -> Column:
    """1 / number of classes named in the prediction (without proper parts of the truth), if the truth is one of them."""
    hit = F.filter(classes, lambda c: F.contains(prediction, c) & ~(F.contains(truth, c) & (c != truth)))
    return F.when(F.array_contains(hit, truth), 1 / F.size(hit)).otherwise(F.lit(0.0))


def f1(a: Column, b: Column) -> Column:
    """F1 of two token multisets (arrays)."""
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, t: s + F.least(_count(a, t), _count(b, t)))
    return F.when((common > 0), 2 * common / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def _count(a: Column, t: Column) -> Column:
    return F.size(F.filter(a, lambda x: x == t))


def qa_f1_score(prediction: Column, truth: Column) -> Column:
    return f1(tokens(normalize_answer(prediction)), tokens(normalize_answer(truth)))


def characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda x: x != "")


def qa_f1_zh_score(prediction: Column, truth: Column) -> Column:
    """By characters, where no word segmentation is at hand."""
    return f1(characters(normalize_zh_answer(prediction)), characters(normalize_zh_answer(truth)))


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays: one row of the table at a time."""

    def line(row: Column, x: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            up, left, diag = F.get(row, j + 1), F.element_at(acc, -1), F.get(row, j)
            return F.concat(acc, F.array(F.when(F.get(b, j) == x, diag + 1).otherwise(F.greatest(up, left))))

        return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.array(F.lit(0)), cell)

    table = F.aggregate(a, F.array_repeat(F.lit(0), F.size(b) + 1), line)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.element_at(table, -1)).otherwise(F.lit(0))


def rouge_l(prediction: Column, truth: Column) -> Column:
    a, b = tokens(prediction), tokens(truth)
    n = lcs(a, b)
    return F.when(n > 0, 2 * n / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def rouge_zh(prediction: Column, truth: Column) -> Column:
    a, b = characters(prediction), characters(truth)
    n = lcs(a, b)
    return F.when(n > 0, 2 * n / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def code_sim_score(prediction: Column, truth: Column) -> Column:
    """Fuzzy ratio (twice the common subsequence by both lengths) of the truth with the prediction's first line that is no comment or fence."""
    lines = F.filter(F.split(F.ltrim(prediction), "\n"), lambda x: ~(F.contains(x, F.lit("`")) | F.contains(x, F.lit("#")) | F.contains(x, F.lit("//"))))
    line = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    a, b = characters(line), characters(truth)
    return F.when(F.size(a) + F.size(b) > 0, 2 * lcs(a, b) / (F.size(a) + F.size(b))).otherwise(F.lit(1.0))


def extract_answer(s: Column) -> Column:
    """The text after the last 'answer is' or '####', up to the line's end."""
    return F.trim(F.regexp_extract(s, r"(?is).*(?:answer is|####)[:\s]*([^\n]*)", 1))
