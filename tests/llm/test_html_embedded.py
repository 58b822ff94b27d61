"""The text of embedded content reaches the cut as part of its block."""

import pytest
from lorebank.llm import html_text


@pytest.mark.parametrize(
    "inner, text",
    [
        ("<math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math>", "x=2"),
        ("<svg viewBox='0 0 9 9'><g><path d='M0 0'/><text>label</text></g></svg>", "label"),
        ("<object data='a'><param name='b'>fallback</object>", "fallback"),
        ("<canvas>drawn</canvas>", "drawn"),
        ("<video src='a'><source src='b'>no video</video>", "no video"),
        ("<audio src='a'>no audio</audio>", "no audio"),
        ("<map name='m'><area href='a'>regions</map>", "regions"),
    ],
)
def test_embedded_text_stays_in_its_block(inner, text):
    page = html_text.read_page(f"<article><p>We have {inner} in this article.</p><p>More.</p></article>")
    assert [b.text for b in page.blocks] == [f"We have {text} in this article.", "More."]
