"""Commands over small tables."""

import json

import pytest

from tarsia.__main__ import main


def test_collect_says_what_it_would_do(capsys):
    assert main(["collect", "--retailer", "unieuro", "--categories", "tv, laptop", "--limit", "3"]) == 0
    assert capsys.readouterr().out.splitlines() == ["would collect up to 3 of tv from unieuro", "would collect up to 3 of laptop from unieuro"]
    assert main(["collect", "--categories", "giardino"]) == 1 and main(["collect", "--retailer", "altro"]) == 1
    with pytest.raises(SystemExit):
        main(["collect", "--limit", "0"])


def test_gates_of_a_file(spark, capsys, tmp_path):
    path = tmp_path / "listings.json"
    path.write_text(json.dumps({"candidates": [{"title": "Samsung Galaxy S24 256GB", "price": "799", "url": "u", "store": "a", "category": "smartphone"}, {"title": "", "price": "1", "url": "u", "store": "a", "category": "tv"}]}))
    assert main(["gates", str(path), "--json"], spark) == 0
    report = json.loads(capsys.readouterr().out)
    assert (report["total"], report["accepted"], report["rejected"]) == (2, 1, 1) and report["by_reason"] == {"missing_name": 1}
    assert "missing_name" in report["examples"]["rejected"][0]["summary"]
    assert main(["gates", str(path)], spark) == 0 and "rejected: 1" in capsys.readouterr().out


def test_reports_and_predictions(spark, sf, capsys, tmp_path):
    assert main(["quality", sf, "--star", "--json", "--scratch", f"file://{tmp_path}"], spark) == 0
    assert set(json.loads(capsys.readouterr().out)["sections"]) == {"products", "offers", "stores", "history", "cross"}
    assert main(["predict", sf, "--star", "--product", "7", "--json", "--limit", "3"], spark) == 0
    rows = json.loads(capsys.readouterr().out)
    assert len(rows) == 3 and all(r["product_id"] == "7" for r in rows)
    assert main(["self-test"], spark) == 0
