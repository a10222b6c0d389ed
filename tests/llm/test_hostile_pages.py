"""Pages without ends of tags, comments and quotes are read in time that grows as they do."""

import time

import pytest

from tallyspark.llm import media

FORMS = ["<a ", "<!--", '<a b="', "<a b='x ", "</", "</a ", "<?", "<!", "<![", "<script>", "<title>", "&#", "<", "<a b=c/ ", "<a =", "<!-->", "<figure><figcaption>"]


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("tail", ["", ">", "-->"])
def test_a_million_characters(form, tail):
    began = time.process_time()
    media.parse_html(form * (1_000_000 // len(form)) + tail)
    assert time.process_time() - began < 20


def test_text_after_the_last_end_stays():
    assert [x["text"] for x in media.parse_html("<p>one</p>two <b three <!-- four")] == ["one", "two <b three <!-- four"]
    assert [x["text"] for x in media.parse_html("<p>one<!-- x --> two <!-- <i>three</i>")] == ["one two <!-- three"]
