import json

import pytest
from conftest import rows

from tillroll.sources.purchases import (
    check_purchase_columns,
    export_csv,
    receipt_rejects,
    scan_purchases_csv,
    scan_receipt_json,
)

KEY = "12345678901" * 4


def test_csv_stays_text(spark, tmp_path):
    file = tmp_path / "lines.csv"
    file.write_text(
        "purchase_date,product_id,quantity,unit_price,product_price,market_id,access_key\n"
        f"2026-04-18,Feijão,4,3.25,13.00,Feira,{KEY}\n"
        '2026-04-18,"Leite, integral",3,5.20,,Feira,\n'
    )
    df = scan_purchases_csv(spark, str(file))
    assert {t for _, t in df.dtypes} == {"string"}
    assert rows(df, "product_id", "product_price", "access_key") == [
        ("Feijão", "13.00", KEY), ("Leite, integral", None, None),
    ]


def test_required_columns():
    check_purchase_columns(["purchase_date", "product_id", "market_id", "quantity", "unit_price"])
    with pytest.raises(ValueError, match="market_id"):
        check_purchase_columns(["purchase_date", "product_id", "product_price"])
    with pytest.raises(ValueError, match="product_price"):
        check_purchase_columns(["purchase_date", "product_id", "market_id", "quantity"])


def item(product, **more):
    return {"purchase_date": "2026-03-09", "product_id": product, "quantity": 2, "unit_price": 4.25,
            "product_price": 8.5, "market_id": "Feira", "access_key": KEY, "nfce_url": "", **more}


def test_receipts_one_per_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([item("Pêra"), item("Uva")], indent=2))
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text("no receipt")
    df = scan_receipt_json(spark, str(tmp_path))
    assert sorted(rows(df, "product_id", "quantity", "product_price")) == [
        ("Pêra", 2.0, 8.5), ("Uva", 2.0, 8.5),
    ]


def test_receipts_one_per_line(spark, tmp_path):
    first, last = [item("A"), item("B", purchase_date="?")], [item("C", quantity="2,5", unit_price="5.5")]
    lines = [json.dumps(first), "[]", json.dumps(last)]
    (tmp_path / "log.txt").write_text("\n".join(lines))
    df = scan_receipt_json(spark, str(tmp_path), per_line=True)
    got = {p: more for p, *more in rows(df, "product_id", "purchase_date", "quantity", "unit_price")}
    assert set(got) == {"A", "B", "C"} and got["B"][0] is None
    assert got["A"][1:] == [2.0, 4.25] and got["C"][1:] == [None, 5.5]


def test_export_and_read_back(spark, golden, tmp_path):
    export_csv(golden, str(tmp_path / "out"))
    assert scan_purchases_csv(spark, str(tmp_path / "out")).count() == 6


def test_csv_of_other_programs(spark, tmp_path):
    head = "purchase_date,product_id,product_price,market_id"
    (tmp_path / "a.csv").write_text(
        head + ',access_key\n2026-04-18,"Arroz ""Tia"" 5kg, tipo 1",13.00,Feira,NULL\n'
        '2026-04-19,"Doce\nde leite",4.00,"Feira ""livre""",n/a\n'
    )
    (tmp_path / "b c.csv").write_text(head + "\n2026-04-20,NA,1.00,Loja\n")
    df = scan_purchases_csv(spark, str(tmp_path), multi_line=True)
    assert sorted(rows(df, "purchase_date", "product_id", "market_id", "access_key")) == [
        ("2026-04-18", 'Arroz "Tia" 5kg, tipo 1', "Feira", None),
        ("2026-04-19", "Doce\nde leite", 'Feira "livre"', None),
        ("2026-04-20", None, "Loja", None),
    ]
    with pytest.raises(ValueError, match="no purchase file"):
        (tmp_path / "empty").mkdir()
        (tmp_path / "empty" / "x.csv").write_text("")
        scan_purchases_csv(spark, str(tmp_path / "empty"))


def test_exported_quotes_are_doubled(spark, tmp_path):
    df = spark.createDataFrame([('a "b", c',)], "name string").coalesce(1)
    export_csv(df, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text == 'name\n"a ""b"", c"\n'


def test_unreadable_receipts_are_set_aside(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([item("Uva")]))
    (tmp_path / "b.json").write_text("no receipt")
    (tmp_path / "c.json").write_text('{"product_id": "x"}')
    found = receipt_rejects(spark, str(tmp_path))
    assert sorted(rows(found, "text", "reason")) == [
        ("no receipt", "receipt"), ('{"product_id": "x"}', "receipt"),
    ]
    assert scan_receipt_json(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="unreadable receipt"):
        scan_receipt_json(spark, str(tmp_path), strict=True).collect()
