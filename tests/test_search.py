import pytest

from waymark.functions import hangul as H
from waymark.operators import search as S

COURSES = [
    ("L01.001", "수학연습", "수리과학부", ["김가나"], ["001"]), ("L02.002", "화학특수연구", "화학부", ["이연수"], ["001"]), ("C10.110", "대학 글쓰기 1", "기초교육원", ["박글"], ["001", "002"]),
    ("C10.111", "(공유)글쓰기의 기초", "국어국문학과", ["나민애"], ["001"]), ("M15.200", "컴퓨터구조", "컴퓨터공학부", ["홍길동"], ["001"]), ("M15.201", "Data Structures", "컴퓨터공학부", ["홍길동"], ["001"]), ("P20.300", "물리학Ⅱ", "물리·천문학부", ["최빛"], ["001"]),
]


@pytest.fixture(scope="module")
def index(spark):
    return S.build_index(spark.createDataFrame(COURSES, "id string, name string, dept string, profs array<string>, section_nos array<string>")).cache()


def names(index, text, **options):
    by = {c[0]: c[1] for c in COURSES}
    return [by[r.id] for r in S.search(index, text, **options).orderBy("score", "place").collect()]


def test_letters():
    assert H.letters("왕") == "ㅇㅗㅏㅇ" and H.join(*H.split("닭")) == "닭" and H.initials("글쓰기 A") == "ㄱㅆㄱ A"
    assert H.norm_key(" 물리학 Ⅱ (Ａ)") == "물리학2a" and H.norm_key(None) == ""


@pytest.mark.parametrize(("typed", "meant"), [("rmfTmrl", "글쓰기"), ("ekfr", "닭"), ("dhkd", "왕"), ("dkdlel", "아이디"), ("123", None), ("xz", None), ("rkqt dlT", "값 있")])
def test_layout(typed, meant):
    assert H.from_qwerty(typed) == meant


def test_loose():
    assert H.loose_readings("자룍ㅈ", before_letter=True) == ["자료ㄱㅈ"] and "반ㅎ" in H.loose_readings("밚")


def test_places(index):
    assert names(index, "글쓰기")[:2] == ["(공유)글쓰기의 기초", "대학 글쓰기 1"]
    assert names(index, "ㄱㅆㄱ") == names(index, "글쓰기")
    assert names(index, "글쓱")[0] == "(공유)글쓰기의 기초"  # still typing
    assert names(index, "rmfTmrl") == names(index, "글쓰기")


def test_words(index):
    assert names(index, "글쓰기 나민애") == ["(공유)글쓰기의 기초"]
    assert names(index, "대학 글쓰기")[0] == "대학 글쓰기 1"
    assert set(names(index, "컴공")) == {"컴퓨터구조", "Data Structures"} or names(index, "컴퓨터공학부") != []
    assert names(index, "수연")[0] == "수학연습"
    assert names(index, "M15.200")[0] == "컴퓨터구조" and names(index, "") == [] and names(index, "zzz") == []
    assert names(index, "일물", aliases={"일물": "물리학"}) == ["물리학Ⅱ"]


def test_marks():
    assert S.highlights("대학 글쓰기 1", "글쓰") == [(3, 5)]
    assert S.split_marks("abcdef", [(1, 3), (2, 4)]) == [("a", False), ("bcd", True), ("ef", False)]


def test_numbers_of_courses(spark):
    rows = [("M1522.000100", "a", "d", ["x"], ["001"]), ("034.005", "b", "d", ["x"], ["001"])]
    index = S.build_index(spark.createDataFrame(rows, "id string, name string, dept string, profs array<string>, section_nos array<string>"))
    score = lambda text: {r.id: round(r.score, 3) for r in S.search(index, text).collect()}
    assert score("034.005 ") == {"034.005": 0.5} and score("034005 ") == {"034.005": 0.8} and score("000100 ")["M1522.000100"] == 5.0
    assert score("1522.0001 ")["M1522.000100"] == 5.0 and score("15220001 ")["M1522.000100"] == 5.3 and score("22000100 ")["M1522.000100"] == 5.8
