from datetime import date
from decimal import Decimal as D

from conftest import rows

from tillroll.operators.receipts import receipt_facts, whole_receipts

KEY = "3526" * 11
SHOP = [
    "",
    "Mercearia do Bairro",
    "CNPJ 11.222.333/0001-44",
    "Rua das Flores 12",
    "CPF do consumidor: 111.222.333-44",
    "24/05/2026 18:01:22",
    "001 7891234567895 LEITE INT MARCA 1L 2 UN x 4,50 9,00",
    "002 QUEIJO MINAS KG",
    "0,750 kg x 12,90 9,68",
    "003 TOTAL CORN FLAKES 300G 15,00",
    "004 SACOLA",
    "005 PAO 3 x 1,00",
    "QTD. TOTAL DE ITENS 4",
    "SUBTOTAL R$ 36,68",
    "TOTAL R$ 36,68",
    "DINHEIRO 50,00",
    "CAIXA 2 PRESENTE 9,99",
    "Chave de acesso",
    " ".join(KEY[i : i + 4] for i in range(0, 44, 4)),
    "https://example.org/nfce?p=abc|2 obrigado",
]


def lines(spark, **receipts):
    data = [(k, n, x) for k, texts in receipts.items() for n, x in enumerate(texts)]
    return spark.createDataFrame(data[::-1], "receipt_id string, line_no long, line string")


def test_a_whole_receipt(spark):
    found = rows(
        whole_receipts(lines(spark, a=SHOP)).orderBy("line_no"),
        "product_id", "quantity", "unit_price", "product_price",
    )
    assert found == [
        ("Leite Int Marca", D("2.000"), D("4.50"), D("9.00")),
        ("Queijo Minas", D("0.750"), D("12.90"), D("9.68")),
        ("Total Corn Flakes", D("1.000"), D("15.00"), D("15.00")),
        ("Pao", D("3.000"), D("1.00"), D("3.00")),
    ]
    shared = rows(
        whole_receipts(lines(spark, a=SHOP)).drop(
            "line_no", "product_id", "quantity", "unit_price", "product_price"
        ).distinct()
    )
    assert shared == [
        (
            "a", date(2026, 5, 24), "Mercearia Do Bairro", KEY, "https://example.org/nfce?p=abc|2",
            D("36.68"), D("36.68"), True,
        )
    ]


def test_what_is_not_shown_is_null(spark):
    found = rows(
        whole_receipts(lines(spark, b=["Loja", None, "ARROZ 5KG 20,00"], c=[], d=["só texto"])),
        "receipt_id", "product_id", "purchase_date", "access_key", "nfce_url", "receipt_total",
        "items_total", "adds_up",
    )
    assert found == [("b", "Arroz", None, None, None, None, D("20.00"), None)]
    assert whole_receipts(lines(spark)).isEmpty()


def test_totals_that_do_not_agree(spark):
    texts = [x.replace("TOTAL R$ 36,68", "TOTAL R$ 36,69") for x in SHOP]
    found = rows(whole_receipts(lines(spark, a=SHOP, b=texts)), "receipt_id", "adds_up")
    assert sorted(set(found)) == [("a", True), ("b", False)]


def test_payments_are_no_items(spark):
    texts = ["Loja", "CAFE 500G 12,00", "TOTAL R$ 12,00", "VALE PRESENTE 12,00", "CAFE 500G 12,00"]
    assert rows(whole_receipts(lines(spark, a=texts)), "line_no", "product_id") == [(1, "Cafe")]


def test_a_receipt_that_holds_most_lines(spark):
    texts = ["Loja", "01/02/2026", *["CAFE 500G 12,00", "005 ACUCAR", "2 x 3,00"] * 2000, "TOTAL R$ 36.000,00"]
    found = whole_receipts(lines(spark, a=texts, b=SHOP)).where("receipt_id = 'a'")
    assert rows(found.groupBy("product_id", "adds_up").count().orderBy("product_id")) == [
        ("Acucar", True, 2000), ("Cafe", True, 2000),
    ]
    facts = receipt_facts(lines(spark, a=texts)).first()
    assert (facts["market_line"], facts["due_line"]) == (0, 6002)


def test_lines_are_read_once(spark):
    plan = whole_receipts(lines(spark, a=SHOP))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan


def test_repeated_and_missing_numbers(spark):
    data = [
        ("a", 0, "Loja"), ("a", 2, "001 CAFE"), ("a", 2, "001 CHA"), ("a", 3, "2 x 3,00"),
        ("a", 5, "2 x 4,00"), ("a", 6, "SAL 1,00"), ("a", 6, "SAL 1,00"), ("a", None, "MEL 1,00"),
        (None, 1, "Loja"), (None, 2, "ARROZ 5,00"),
    ]
    repeated = spark.createDataFrame(data, "receipt_id string, line_no long, line string")
    found = rows(whole_receipts(repeated), "line_no", "product_id", "product_price", "items_total")
    assert sorted(found) == [
        (3, "Cafe", D("6.00"), D("14.00")), (3, "Cha", D("6.00"), D("14.00")),
        (6, "Sal", D("1.00"), D("14.00")), (6, "Sal", D("1.00"), D("14.00")),
    ]
