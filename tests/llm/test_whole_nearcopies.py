"""Op 7 on copies of which one repeats a part very often."""

from test_nearcopies import check


def test_repeated_parts(documents, make):
    rows = []
    for times in (100, 1000):
        for part in (12, 20):
            base, refrain = make(200), make(part)
            rows += [(len(rows), base), (len(rows) + 1, f"{base} {' '.join([refrain] * times)}"), (len(rows) + 2, f"{refrain} {base}")]
    check(documents, rows)
