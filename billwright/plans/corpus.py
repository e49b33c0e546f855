"""Input tables for the registered queries, derived from the given tables.

Everything here is row-local: an invoice is written from one ``orders`` row, the
OCR words of a page from one ``documents`` row. No table is joined or grouped to
make input, so no hot key can gather rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billwright.session import input_partitions, spread

INVOICES, DOCUMENTS = "invoices", "documents"

# Label ids of the token classifier (numbering is our choice).
LABELS = {
    0: "O",
    1: "B-COMPANY",
    2: "I-COMPANY",
    3: "B-ADDRESS",
    4: "I-ADDRESS",
    5: "B-DATE",
    6: "I-DATE",
    7: "B-TOTAL",
    8: "I-TOTAL",
}

# OCR settings in their order of preference.
OCR_CONFIGS = ("", "--psm 3", "--psm 4", "--psm 6", "--psm 11", "--psm 12")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


# ---- Invoices from orders --------------------------------------------------------
# Parts of the text are written in Spark SQL: plain row-wise CASE expressions.
# ``k`` is the order key, ``c`` the price in cents.
_CENTS = "cast(round(o_totalprice * 100) as bigint)"
_ITEM_CENTS = "((c + i * 3701) % 250000 + 100)"


def _money(cents: str) -> str:
    return f"concat(cast({cents} div 100 as string), '.', lpad(cast({cents} % 100 as string), 2, '0'))"


def _grouped_money(cents: str) -> str:
    return (
        f"concat(cast({cents} div 100000 as string), ',', "
        f"lpad(cast({cents} div 100 % 1000 as string), 3, '0'), '.', "
        f"lpad(cast({cents} % 100 as string), 2, '0'))"
    )


_ITEM_LINE = f"""
CASE (k + i) % 6
  WHEN 0 THEN concat('Blue Pen 2 ', {_money(f'({_ITEM_CENTS} div 2)')}, ' ', {_money(_ITEM_CENTS)})
  WHEN 1 THEN concat(cast(i + 1 as string), ' x Red Mug ', {_money(_ITEM_CENTS)})
  WHEN 2 THEN concat('Wooden\nChair No. ', cast(i as string), ' $', {_money(_ITEM_CENTS)})
  WHEN 3 THEN concat('Desk Lamp ', {_grouped_money(_ITEM_CENTS)})
  WHEN 4 THEN concat('Tea - ', cast(k % 50 as string), ' g\n', {_money(_ITEM_CENTS)})
  ELSE concat('Paper RM ', {_money(_ITEM_CENTS)})
END"""

_INVOICE_LINES = (
    "CASE WHEN k % 3 <> 1 THEN '# # second print # #' END",
    """CASE k % 6
         WHEN 0 THEN concat('Vendor ', cast(k % 97 as string), ' SDN BHD')
         WHEN 1 THEN concat('  Vendor ', cast(k % 97 as string), ' Ltd')
         WHEN 2 THEN concat('Prince Cafe ', cast(k % 97 as string))
         WHEN 3 THEN concat('Shop ', cast(k % 97 as string), ' Corp.')
         WHEN 4 THEN concat('Kedai ', cast(k % 97 as string)) END""",
    "CASE WHEN k % 4 = 0 THEN 'Reg. no. 77-4410 Q' END",
    "truth_number_line",
    "truth_date_line",
    """CASE k % 5
         WHEN 1 THEN concat('Bill To: ', name, ' c', cast(o_custkey as string), '@example.com')
         WHEN 2 THEN concat('BILLED TO', '\n\n', name)
         WHEN 3 THEN CASE WHEN k % 2 = 0 THEN 'Bill To:' ELSE 'Customer - Al' END
         WHEN 4 THEN concat('Billing Name - ', name) END""",
    """CASE WHEN k % 19 = 0 THEN 'Item Qty Total'
            WHEN k % 23 <> 0 THEN 'Description Qty Price Amount' END""",
    "items",
    """CASE k % 8
         WHEN 0 THEN concat('SUBTOTAL: ', total_text, '\nTOTAL: ', total_text)
         WHEN 1 THEN concat('TOTAL: RM ', total_text)
         WHEN 2 THEN concat('Total\n', total_text)
         WHEN 3 THEN concat('GRAND TOTAL: ', total_grouped)
         WHEN 4 THEN concat('Thank you')
         ELSE concat('TOTAL: ', total_text) END""",
)


# Rows whose invoice gives the month first, and the pattern that swaps day and month.
MONTH_FIRST_ROWS = "source IN ('1-URGENT', '3-MEDIUM') AND doc_id % 29 <> 0"
SWAP = (r"(Date: )([0-9]{2})([/-])([0-9]{2})([/-])", "$1$4$3$2$5")


def invoices(orders: DataFrame) -> DataFrame:
    """One invoice text per order, with the values that were written into it.

    The texts cover every rule: three date forms, missing fields, amounts with
    and without separators, items over several lines, headings that close their
    own section, totals the pattern misses, Windows line ends, and failed scans
    (null text).
    """
    base = orders.selectExpr(
        "o_orderkey AS k", "o_custkey", "o_orderdate", f"{_CENTS} AS c", "o_orderpriority"
    )
    lines = base.withColumns(
        {
            "name": F.expr("concat('Customer#', lpad(cast(o_custkey as string), 9, '0'))"),
            "truth_number": F.expr(
                "CASE WHEN k % 7 > 1 THEN concat('INV-', lpad(cast(k as string), 9, '0')) END"
            ),
            "truth_date": F.expr(
                """CASE WHEN k % 11 = 0 THEN NULL
                        WHEN k % 4 = 1 THEN date_format(o_orderdate, 'yyyy-MM-dd')
                        WHEN k % 4 = 2 THEN date_format(o_orderdate, 'dd-MM-yy')
                        ELSE date_format(o_orderdate, 'dd/MM/yyyy') END"""
            ),
            "items": F.expr(
                f"array_join(transform(sequence(0, cast(k % 6 as int)), i -> {_ITEM_LINE}), '\n')"
            ),
            "total_cents": F.expr(
                "aggregate(sequence(0, cast(k % 6 as int)), 0L, "
                f"(s, i) -> s + {_ITEM_CENTS})"
            ),
        }
    ).withColumns(
        {
            "truth_number_line": F.expr(
                """CASE WHEN k % 7 = 1 THEN concat('Invoice No: ', lpad(cast(k as string), 9, '0'))
                        WHEN k % 7 = 2 THEN concat('receipt ', lower(truth_number))
                        WHEN truth_number IS NOT NULL THEN concat('Invoice No: ', truth_number) END"""
            ),
            "truth_date_line": F.expr(
                """CASE WHEN truth_date IS NULL THEN NULL
                        WHEN k % 4 = 3 THEN concat('Date: ', truth_date, ' 09:41:27 PM Due: ',
                                                   date_format(o_orderdate, 'yyyy/MM/dd'))
                        ELSE concat('Date: ', truth_date) END"""
            ),
            "total_text": F.expr(_money("total_cents")),
            "total_grouped": F.expr(_grouped_money("total_cents")),
        }
    )
    text = f"concat_ws('\n', {', '.join(_INVOICE_LINES)})"
    written = lines.withColumn("body", F.expr(text)).withColumn(
        "text",
        F.expr(
            """CASE WHEN k % 37 = 3 THEN NULL
                    WHEN k % 13 = 5 THEN replace(body, '\n', '\r\n')
                    ELSE body END"""
        ),
    )
    return written.select(
        F.col("k").alias("doc_id"),
        F.lit(INVOICES).alias("corpus"),
        F.lit("en").alias("lang"),
        F.col("o_orderpriority").alias("source"),
        "text",
        "truth_number",
        "truth_date",
        F.expr("CASE WHEN k % 8 <> 4 THEN cast(total_cents as double) / 100 END").alias(
            "truth_total"
        ),
        F.expr("CASE WHEN k % 5 IN (1, 2, 4) THEN name END").alias("truth_name"),
        "o_orderdate",
    )


def with_mixed_dates(texts: DataFrame) -> DataFrame:
    """Invoices of some sources write the month first, but for a few that keep the day first.

    What follows ``Date: `` is swapped, days and years of the other dates stay.
    """
    swapped = F.regexp_replace("text", *SWAP)
    return texts.withColumn("text", F.when(F.expr(MONTH_FIRST_ROWS), swapped).otherwise(F.col("text")))


def read_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(
        spark,
        sf_dir,
        "orders",
        "o_orderkey",
        "o_custkey",
        "o_orderdate",
        "o_totalprice",
        "o_orderpriority",
    )
    return invoices(spread(orders, input_partitions(spark)))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "source", "text")
    docs = spread(docs, input_partitions(spark))
    return docs.select("doc_id", F.lit(DOCUMENTS).alias("corpus"), "lang", "source", "text")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All invoices and all documents: (doc_id, corpus, lang, source, text)."""
    columns = ["doc_id", "corpus", "lang", "source", "text"]
    return (
        read_invoices(spark, sf_dir)
        .select(*columns)
        .unionByName(read_documents(spark, sf_dir).select(*columns))
    )


# ---- OCR words, page sizes and token predictions from documents -------------------
def ocr_words(documents: DataFrame) -> DataFrame:
    """Word table of an OCR run over each document: every blank-separated piece."""
    return documents.select(
        "doc_id", F.posexplode(F.split("text", " ")).alias("row_no", "text")
    ).select(
        "doc_id",
        "row_no",
        "text",
        ((F.col("doc_id") * 7 + F.col("row_no") * 13) % 101).cast("double").alias("conf"),
        ((F.col("row_no") % 10) * 40).alias("left"),
        (F.floor(F.col("row_no") / 10) * 20).cast("int").alias("top"),
        (F.length("text") * 8).alias("width"),
        F.lit(16).alias("height"),
    )


def page_sizes(documents: DataFrame) -> DataFrame:
    """Page width and height per document; some pages have no width (bad scans)."""
    return documents.select(
        "doc_id",
        F.when(F.col("doc_id") % 50 == 7, 0).otherwise(480).alias("width"),
        ((F.floor(F.size(F.split("text", " ")) / 10) + 1) * 20).cast("int").alias("height"),
    )


def _word_label(doc_id: Column, word_idx: Column) -> Column:
    kind = (doc_id + F.floor(word_idx / 3)) % 5
    begins = (word_idx % 3 == 0) & (word_idx % 7 != 0)
    return (
        F.when(kind == 0, 0).when(begins, 2 * kind - 1).otherwise(2 * kind).cast("int")
    )


def token_predictions(kept_words: DataFrame) -> DataFrame:
    """Label per sub-word token: a special token per page, then one or two per word.

    The second token of a word carries another label, which must be ignored; a
    few tokens carry the padding label -100.
    """
    word = F.col("word_idx")
    label = _word_label(F.col("doc_id"), word)
    padded = F.when(word % 41 == 40, -100).otherwise(label)

    # the parts of a word: the page's special token, its first and its second token
    part = F.col("part")
    parts = kept_words.select(
        "doc_id", "word_idx", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("part")
    ).filter(F.when(part == 0, word == 0).when(part == 2, word % 2 == 0).otherwise(F.lit(True)))
    return parts.select(
        "doc_id",
        F.when(part == 0, 0).otherwise(2 * word + part).cast("bigint").alias("token_idx"),
        F.when(part != 0, word).cast("bigint").alias("word_idx"),
        F.when(part == 0, 0).when(part == 1, padded).otherwise((label + 1) % 9).cast("int").alias("label_id"),
    )


def ocr_variants(documents: DataFrame) -> DataFrame:
    """Text of each page under every OCR setting; lengths differ and often tie."""
    text, doc = F.col("text"), F.col("doc_id")
    texts = (
        text,
        F.replace(text, F.lit(","), F.lit("")),
        F.when(doc % 3 == 0, F.concat(text, F.lit(" ~"))).otherwise(text),
        F.when(doc % 4 == 1, F.concat(text, F.lit(" ."))).otherwise(
            F.replace(text, F.lit("e"), F.lit("E"))
        ),
        F.when(doc % 5 == 2, F.concat(text, F.lit("---"))).otherwise(text),
        F.replace(text, F.lit(" "), F.lit("")),
    )
    variants = F.array(
        *[
            F.struct(
                F.lit(rank).alias("config_rank"),
                F.lit(config).alias("config"),
                t.alias("text"),
            )
            for rank, (config, t) in enumerate(zip(OCR_CONFIGS, texts, strict=True))
        ]
    )
    return documents.select("doc_id", F.explode(variants).alias("v")).select(
        "doc_id", "v.*"
    )


# ---- Files of a landing folder, from documents -------------------------------------
def landed_files(documents: DataFrame) -> DataFrame:
    """File listing (path, length, content) as a binary file scan returns it."""
    ext = F.element_at(
        F.array(*[F.lit(e) for e in ("jpg", "png", "jpeg", "PNG", "txt")]),
        (F.col("doc_id") % 5 + 1).cast("int"),
    )
    content = F.encode("text", "UTF-8")
    return documents.select(
        F.concat(
            F.lit("/landing/"),
            F.when(F.col("doc_id") % 9 == 4, "sub/").otherwise(""),
            F.lit("receipt"),
            (F.floor(F.col("doc_id") / 10) * 2 + F.col("doc_id") % 2).cast("string"),
            F.lit("."),
            ext,
        ).alias("path"),
        F.octet_length(content).cast("bigint").alias("length"),
        content.alias("content"),
    )


# ---- Format templates --------------------------------------------------------------
# One row per mark: company forms of 97 vendors and shops, and marks that several of them hold.
TEMPLATES = """
SELECT concat('Vendor ', cast(n as string), ' SDN BHD') AS mark, 30 AS priority,
  concat('Vendor ', cast(n as string)) AS name, 99.0D AS confidence, true AS supported FROM numbers
UNION ALL SELECT concat('Shop ', cast(n as string)), 20 + n % 3, concat('Shop group ', cast(n % 7 as string)), 90.0D, n % 2 = 0 FROM numbers
UNION ALL SELECT concat('Kedai ', cast(n as string), chr(10)), 25, 'Kedai', 80.0D, true FROM numbers WHERE n % 10 = 0
UNION ALL SELECT 'SDN BHD', 10, 'Template A (Retail)', 95.0D, true FROM numbers WHERE n = 0
UNION ALL SELECT 'hop 1', 40, 'Overlapping mark', 50.0D, false FROM numbers WHERE n = 0
UNION ALL SELECT 'Corp.', 20, 'Corporation', 70.0D, true FROM numbers WHERE n = 0"""


def format_templates(spark: SparkSession) -> DataFrame:
    """About 200 templates, made by a rule from the numbers 0 to 96."""
    numbers = spark.range(97).withColumnRenamed("id", "n")
    made = spark.sql(TEMPLATES.replace("numbers", "{numbers}"), numbers=numbers)
    return made.withColumn("indicators", F.array(F.concat(F.lit("Found "), "mark")))


# ---- Image files, from documents ----------------------------------------------------
# Width, height and colour type follow the document's number; so does what is wrong.
IMAGE_WIDTH, IMAGE_HEIGHT = "1 + doc_id % 5000", "1 + doc_id * 7 % 3000"
IMAGE_KIND = "CASE WHEN doc_id % 2 = 0 THEN 'png' ELSE 'jpeg' END"
IMAGE_COLOUR = "CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 6 END"
IMAGE_COMPONENTS = "CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END"
IMAGE_FAULT = """CASE doc_id % 17 WHEN 3 THEN 'cut_file' WHEN 5 THEN 'cut_header' WHEN 7 THEN 'not_an_image'
  WHEN 11 THEN 'bad_header' WHEN 13 THEN 'no_content' END"""


def _bytes(number: str, digits: int) -> str:
    return f"unhex(lpad(hex(cast({number} as bigint)), {digits}, '0'))"


def image_files(documents: DataFrame) -> DataFrame:
    """(path, content): a PNG or JPEG file per document, whose data are the document's text.

    JPEG files carry some application segments before their frame. Some files are cut, empty,
    or have a wrong header. All bytes are written by column functions.
    """
    rows = documents.selectExpr(
        "doc_id", f"{IMAGE_KIND} AS kind", f"{IMAGE_FAULT} AS fault", "encode(coalesce(text, ''), 'UTF-8') AS body"
    )
    size = f"{_bytes(IMAGE_WIDTH, 8)}, {_bytes(IMAGE_HEIGHT, 8)}"
    header = f"concat(unhex('49484452'), {size}, unhex('08'), {_bytes(IMAGE_COLOUR, 2)}, unhex('000000'))"
    rows = rows.withColumn("header", F.expr(header)).withColumns(
        {
            "png": F.expr(
                "concat(unhex('89504E470D0A1A0A0000000D'), header, "
                f"{_bytes('crc32(header) + CASE WHEN fault = {0} THEN 1 ELSE 0 END', 8)}".replace("{0}", "'bad_header'")
                + f", {_bytes('octet_length(body)', 8)}, unhex('49444154'), body, {_bytes('crc32(body)', 8)}, "
                "unhex('0000000049454E44AE426082'))"
            ),
            "jpeg": F.expr(
                "concat(unhex('FFD8'), "
                "CASE WHEN fault = 'bad_header' THEN unhex('00') ELSE unhex('') END, "
                "CASE WHEN doc_id % 4 = 1 THEN unhex('FFE000104A46494600010100000100010000') ELSE unhex('FFFF01') END, "
                # FFxx bytes within a segment's data must not be taken for markers
                "unhex(repeat('FFE20006FFC0FFDA', cast(doc_id % 100 as int))), "
                f"unhex('FFC2'), {_bytes(f'8 + 3 * ({IMAGE_COMPONENTS})', 4)}, unhex('08'), "
                f"{_bytes(IMAGE_HEIGHT, 4)}, {_bytes(IMAGE_WIDTH, 4)}, {_bytes(IMAGE_COMPONENTS, 2)}, "
                f"unhex(repeat('011100', {IMAGE_COMPONENTS})), unhex('FFDA000201'), body, unhex('FFD9'))"
            ),
        }
    )
    content = F.expr(
        """CASE WHEN fault = 'no_content' THEN unhex('') WHEN fault = 'not_an_image' THEN body
          WHEN fault = 'cut_header' THEN substring(CASE kind WHEN 'png' THEN png ELSE jpeg END, 1, 16)
          WHEN fault = 'cut_file' THEN substring(CASE kind WHEN 'png' THEN png ELSE jpeg END, 1,
            octet_length(CASE kind WHEN 'png' THEN png ELSE jpeg END) - 1)
          ELSE CASE kind WHEN 'png' THEN png ELSE jpeg END END"""
    )
    return rows.select(F.format_string("/scans/%d.%s", "doc_id", "kind").alias("path"), content.alias("content"))
