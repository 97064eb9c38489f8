def same(frame, expected, names):
    """Rows of `frame` as tuples of `names` equal the expected ones, in any order."""
    got = sorted((tuple(r[n] for n in names) for r in frame.select(*names).collect()), key=repr)
    want = sorted(expected, key=repr)
    assert len(got) == len(want)
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    assert not wrong, wrong[:3]
