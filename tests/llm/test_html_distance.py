"""Distances between blocks of a page are exact, however many blocks lie between."""

from texweave.llm import html


def test_short_blocks_far_from_both_ends():
    good = "This is the text of the article and it has a lot to say of what there was and will be for you and all. " * 3
    links = "".join("some links go here and there now " for _ in range(6))
    for n in (40, 101, 300):
        words = [f"Word {'x' * (30 if k < n // 3 else 1)} {k}" for k in range(n)]
        page = f"<p>{good}</p>" + "".join(f"<p>{w}</p>" for w in words) + f"<p><a href='x'>{links}</a></p>"
        want = [w for k, w in enumerate(words) if sum(map(len, words[:k])) <= sum(map(len, words[k + 1 :]))]
        assert html.main_text(page).split("\n\n") == [good.strip(), *want]
