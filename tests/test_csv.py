"""CSV written by pandas: doubled quotes, separators and line breaks inside values."""

import pandas as pd

from panelwatch.sources.io import load_panel, write_panel


def test_quoted_values(spark, tmp_path):
    rows = pd.DataFrame({"k": [1, 2, 3], "text": ['say "hi", ok', "two\nlines", " a\\b "], "v": [0.5, 1.5, 2.5]})
    rows.to_csv(tmp_path / "rows.csv", index=False)
    found = load_panel(spark, str(tmp_path / "rows.csv"))
    assert dict(found.dtypes)["v"] == "double"
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.itertuples(index=False)))
    write_panel(found, str(tmp_path / "again"), "csv")
    again = load_panel(spark, str(tmp_path / "again"), "csv", found.schema)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.itertuples(index=False)))
