import time

import pytest

from tidewright.llm import sentences as S


def pieces(text, hint=None):
    return [text[a - 1 : b] for a, b in S.sentences(text, hint)]


@pytest.mark.parametrize("blanks", [1, 39, 40, 41, 5_000])
def test_white_space_of_any_length(blanks):
    assert pieces("One is here." + " " * blanks + "Two is here.") == ["One is here.", "Two is here."]
    assert len(pieces("One is here.\t" + " " * blanks + "Two is here, e.g." + " " * blanks + "this one.")) == 2


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Er kam am" + " " * 60 + "3. Mai an. Gut so.", 2),  # the rule's words stand far before the mark
        ("«Ждите. Скоро будем.» Он ушёл.", 2), ("他说“好。”然后走了。天黑了。", 2), ("彼は「はい。」と言った。「いいえ。」", 2),
        ("ไม่ทราบว่าทำไมของถึงช้าครับ ยังไม่มาเลย", 2), ("(Wait here. Not there.) Then go.", 2), ('She asked: "Why? When?" and left. Ok.', 2),
        ("we waited e.g. two days. then it came", 2), ("end of it.Rev. Brown came.", 2), ("Version 2.5 of www.shop.example. Works.", 2), ("", 0), ("   \n ", 0), (None, 0),
    ],
)
def test_rules(text, want):
    assert len(S.sentences(text)) == want


@pytest.mark.parametrize(
    "unit",
    ['He said "no (not) now." and (yes.) then. ', "see https://x.y/z. and a@b.co. Then ", "ไม่ทราบว่าทำไมของถึงช้า ยังไม่มาเลยค่ะ ", "a. b. c. ", '("a. ', "(‘a’. ", "One." + " " * 50, "他说“好。”然后走了。", "a’.) "],
)
def test_time_goes_with_length(unit):
    def took(n):
        best = 1e9
        for _ in range(3):
            t = time.process_time()
            S.sentences(unit * n)
            best = min(best, time.process_time() - t)
        return best

    small, large = took(1_500), took(12_000)
    assert large < 8 * 3 * small + 0.2  # eight times the text; squares would take 64 times


def test_spans_nest_and_are_sorted():
    assert S._spans('(a "b" [c) d] “e”') == [(0, 9), (3, 5), (14, 16)]
    assert S._spans("'tis (open « and „x“") == [(17, 19)]
