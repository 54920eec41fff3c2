"""Strings that the rules of ages, sexes and titled names accept and refuse, one detector at a time."""

import pytest
from pyspark.sql import functions as F

from hushframe.operators.detect import RULES, detect, needs_han

ACCEPTED = {
    "age": {"今年45岁。": "45岁", "，3 周岁": "3 周岁", "患儿8个月": "8个月", "月龄：8月龄": "8月龄", "年龄 = 10月": "10月", "已9个月大": "9个月大", "七十二岁": "七十二岁", "两岁": "两岁", "120岁": "120岁"},
    "sex": {"性别：男": "男", "性别 女": "女", "患者，男性，": "男性", "病人女35": "女", "男，45岁": "男", "女 、7周岁": "女", "该男性患者": "男", "女性就诊": "女"},
    "doctor_name": {"王伟医生": "王伟", "欧阳海大夫": "欧阳海", "主治医师：李静，": "李静", "医生张伟": "张伟", "签名 刘洋": "刘洋"},
    "nurse_name": {"王芳护士": "王芳", "护士长：赵敏。": "赵敏", "护师李娜": "李娜"},
    "relative_name": {"其妻：王芳，": "王芳", "父亲李伟": "李伟", "家属 配偶 张静。": "张静"},
}
REFUSED = {
    "age": ["12.5岁", "60岁以上", "60岁及以下", "不足1岁", "多见于60岁", "121岁", "七十岁年代", "纳入三十岁", "3-5岁", "8个月", "岁月"],
    "sex": ["男病房", "男方", "四男，45岁", "性别不详", "患者男朋友", "女性健康"],
    "doctor_name": ["主任医师查房", "共12名医生", "医生站", "主任医生"],
    "nurse_name": ["责任护士执行", "护士站", "护士长巡视"],
    "relative_name": ["家属陪同", "其妻陪同"],
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, text) for table in (ACCEPTED, REFUSED) for name, texts in table.items() for text in texts]
    df = spark.createDataFrame(rows, "name string, text string")
    out = {}
    for name in ACCEPTED:
        told = df.where(F.col("name") == name).select("text", detect(F.col("text"), [name]).alias("facts")).collect()
        out |= {(name, r["text"]): [f["value"] for f in r["facts"]] for r in told}
    return out


@pytest.mark.parametrize("name", ACCEPTED)
def test_accepted(found, name):
    assert {t: found[name, t] for t in ACCEPTED[name]} == {t: [v] for t, v in ACCEPTED[name].items()}


@pytest.mark.parametrize("name", REFUSED)
def test_refused(found, name):
    assert {t: found[name, t] for t in REFUSED[name]} == {t: [] for t in REFUSED[name]}


def test_texts_without_han_characters_lose_no_rule(spark):
    """What the rules of the other scripts find is the same whether all rules are asked or those alone."""
    others = tuple({r.detector for r in RULES if not needs_han(r)})
    text = "call 13812345678, a@b.example.com 10.1.1.7 2024-05-06 5/6/2024 patient John Smith, MRN: A123 QQ 12345 postal code 123456 0755-12345678 https://x.example.org/ diagnosis"
    row = spark.createDataFrame([(text,)], "text string").select(detect(F.col("text")).alias("a"), detect(F.col("text"), others).alias("b")).first()
    key = lambda fs: [(f["type"], f["start"], f["value"]) for f in fs]
    assert key(row["a"]) == key(row["b"]) and len(row["a"]) >= 11


def test_a_repeated_term_is_refused(tmp_path):
    from hushframe.operators.dictionary import load

    path = tmp_path / "d.csv"
    path.write_text("category,name\nward,甲\nward, 甲\n", encoding="utf-8")
    with pytest.raises(ValueError, match="twice"):
        load(str(path))
    path.write_text("category,name\nward,甲\nstaff,甲\n", encoding="utf-8")
    assert load(str(path)) == [("甲", "staff"), ("甲", "ward")]
