"""Whole reports of pages of our own, each built around one rule; the numbers follow from the rules by hand.

A field is an element of a text tag that has text of its own, or a picture with an address. Each text gets the value
"Sample " and its label. That is a risk of 20 where it is over two and a half times as long as a text of four characters
or more. Success is the mean of 100, the share of values that landed, safety and structure, and 0 if nothing was applied.
"""

import pytest

from loomspan.operators import nodes, sections
from loomspan.plans.evaluation import repurpose

#: A timetable: no section's role is known, so that labels are "Cell" and "Header Cell" ("Sample Cell": 11 characters).
#: Seven texts. 09:10 and 17:45 have five characters, which 11 does not exceed by the factor (12.5); "Mon" and "Tue" are too
#: short to count; "Hall" (4): "Sample Header Cell" has 18, over 10.
TIMETABLE = (
    "<table><tbody><tr><th>Hall</th><th>Weekday of departure</th></tr><tr><td>Mon</td><td>09:10</td></tr><tr><td>Tue</td><td>17:45</td></tr></tbody></table><p></p><p>--</p>"
    "<dl><dt>On request, by phone, a day ahead</dt></dl>"
)
#: A letter in a main element: paragraphs nest their text in spans, so that the spans are the fields; one paragraph has
#: text of its own after its span. No text is short. "Sample Text" is 11 long.
LETTER = "<main><p><span>Dear neighbours of the lower street</span> and of the upper one</p><p><span>The well is dry again</span></p><blockquote>Water is a common good</blockquote><p><em>Yours, the keeper</em></p></main>"
#: Pictures alone: four with an address, one without. Nothing can be applied.
WALL = "<figure><img src='n1.webp'><img src='n2.webp'></figure><div><figure><img src='n3.webp'></figure><img alt='lost'><img src='n4.webp'></div>"
#: A help section with one disclosure among four paragraphs, and a dropdown outside of it. Roles: faq ("Sample Faq ..."),
#: sidebar from the aside. "Why?" (4) is a button: "Sample Faq Button", 17, over 10. "Ask!" (4): "Sample Sidebar List Item", 24.
HELP = (
    '<div id="faqs-all"><button aria-expanded="true" aria-controls="w">Why?</button><div id="w"><p>Because the tide comes in at noon there.</p></div><p>Bring boots, a rope and a spare lamp.</p></div>'
    '<aside><div class="dropdown"><ol><li>Ask!</li><li>Or call on the warden in the tower</li></ol></div></aside>'
)
#: Two slideshows, the second with a single child, which is none; a tab list with three tabs of which two have panels.
MOVING = (
    '<div class="x-slideshow"><h4>Dawn over the salt flats</h4><h5>Dusk over the salt flats</h5></div><div class="glide"><cite>Alone here, as it were</cite></div>'
    '<div><ul role="tablist"><li role="tab" aria-controls="p1">Harvest and storage</li><li role="tab" aria-controls="p2">Seeds for the spring</li><li role="tab" aria-controls="p9">Nothing behind this</li></ul>'
    '<div id="p1" role="tabpanel">One</div><div id="p2" role="tabpanel">Two</div></div>'
)
#: Nothing to fill in at all.
BARE = "<hr><div><div></div></div>"

#: Page, fields, texts applied, risks, parts that can be restored without script.
KINDS = {
    "timetable": (TIMETABLE, 7, 7, 1, 0), "letter": (LETTER, 5, 5, 0, 0), "wall": (WALL, 4, 0, 0, 0), "help": (HELP, 5, 5, 2, 2), "moving": (MOVING, 6, 6, 0, 2), "bare": (BARE, 0, 0, 0, 0),
}


@pytest.fixture(scope="module")
def report(spark):
    pages = spark.createDataFrame([(i, f"<html><body>{page}</body></html>") for i, (page, *_) in enumerate(KINDS.values())], "page_id long, html string")
    restored = sections.interactive(nodes.parse_html(pages)).groupBy("page_id").count().collect()
    return {r.page_id: r for r in repurpose(pages).collect()}, {r.page_id: r["count"] for r in restored}


@pytest.mark.parametrize("kind", KINDS)
def test_pages_of_a_kind(report, kind):
    i = list(KINDS).index(kind)
    _, fields, applied, risks, restored = KINDS[kind]
    r = report[0][i]
    safety = 100.0 - 20 * risks
    assert (r.n_fields, r.applied, r.present, r.safety, r.structural, report[1].get(i, 0)) == (fields, applied, applied, safety, 100.0, restored)
    assert r.success == (round((300 + safety) / 4, 2) if applied else 0.0)
