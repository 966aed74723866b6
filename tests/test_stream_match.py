"""stream_match votes between cosine and edit distance."""

from tallyweave.operators import matching
from tallyweave.plans import reconcile


def test_both_methods_vote(spark, data):
    t = reconcile.tables(spark, data)
    edit = {r["norm"]: (r["std_id"], r["score"]) for r in matching.match_edit(t["items"], t["std"]).collect()}
    near = {r["norm"]: (r["std_id"], r["score"] * 2 - 1) for r in matching.match_search(t["items"], t["std"]).collect()}
    got = {r["norm"]: r["std_id"] for r in reconcile.QUERIES["stream_match"](spark, data).collect()}
    want = {}
    for norm, (e, score) in edit.items():
        c, cosine = near[norm]
        want[norm] = c if c == e or cosine >= score else e
    assert got == want
    assert any(want[norm] != edit[norm][0] for norm in want) and any(want[norm] != near[norm][0] for norm in want)
