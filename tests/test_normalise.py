import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.addresses import parse_address
from tessera.functions.names import FIXES, fixes, parse_name

NAMES = [
    ("Studio 54 Inc", "studio 54", "inc"),
    ("KEYST0NE Solutions LLC", "keystone solutions", "llc"),
    ("S.B.I. Life Insurance Co. Ltd.", "sbi life insurance", "co ltd"),
    ("www.acme-shop.com", "acmeshop", ""),
    ("#bestdeals", "bestdeals", ""),
    ("John Smith dba Smith Plumbing", "smith plumbing", ""),
    ("ABC Traders Pvt Ltd | XYZ", "abc traders", "ltd pvt"),
    ("Tata Motors (India)", "tata motors", ""),
    ("VIDYALAYA VIDYALAYA school", "vidyalaya school", ""),
    ("Société Générale SARL", "societe generale", "sarl"),
    ("श्री गणेश ट्रेडर्स", "ganesh tredars", ""),
    ("ਗੁਰੂ ਨਾਨਕ ਡੇਅਰੀ", "guru nanak deari", ""),
    ("Café de la Paix", "cafe paix", ""),
    ("The Bank of America Corporation", "bank america", "corp"),
    ("L'Oréal S.A.", "oreal", "sa"),
    ("AT&T Inc.", "at t", "inc"),
    ("Ms Priya Boutique", "priya boutique", ""),
    ("Route 66 Diner", "route 66 diner", ""),
    ("Planet 9 Studios", "planet 9 studios", ""),
    ("5ervices Regiona1 LLC", "services regional", "llc"),
    ("1st Choice", "1st choice", ""),
    ("Agr0 Tech", "agro tech", ""),
    ("8km Foods", "8km foods", ""),
    ("2eme Art", "2eme art", ""),
    ("Acme 1lc", "acme", "llc"),
    ("Eye Clinic LLC #74779", "eye clinic", "llc"),
    ("Horizon Media Service (ID: 42438)", "horizon media service", ""),
    ("Chiropractic Frontier Health - 1072011349", "chiropractic frontier health", ""),
    ("M/s Sharma Traders", "sharma traders", ""),
    ("M/S. Gupta & Sons", "gupta sons", ""),
    ("#74779", "74779", ""),
    ("", "", ""),
    (None, "", ""),
]
ADDRESSES = [
    ("N° 8 Rue de la Paix, Paris, Île-de-France", "France", {"paix", "rue"}, {8}, "ile de france"),
    ("1234 N Main St, Ste 200, Springfield, Illinois, 62701", "US", {"main", "north", "springfield", "street", "suite"}, {200, 1234, 62701}, "illinois"),
    ("Near SBI ATM, 12/3 MG Rd, Bombay, Maharashtra", "India", {"atm", "mg", "mumbai", "near", "road", "sbi"}, {3, 12}, "maharashtra"),
    ("PO Box 77, 9 St Marys Rd, Tamil Nadu", "India", {"marys", "road", "street"}, {9}, "tamil nadu"),
    ("C/O Ram Kumar, 45 Park Street, Kolkata, WB", "India", {"kolkata", "kumar", "park", "ram", "street"}, {45}, "west bengal"),
    ("12 Avenue des Champs-Élysées, 75008 Paris, Ile de France", "France", {"avenue", "champs", "elysees", "paris"}, {12, 75008}, "ile de france"),
    ("", "US", set(), set(), ""),
    (None, None, set(), set(), ""),
    ("Ste 5, 100 Oak Ave, Austin, TX", "US", {"austin", "avenue", "oak", "suite"}, {5, 100}, "texas"),
    ("Plot 7, Sector 9, Phase2, Noida, UP", "India", {"noida", "plot", "sector"}, {2, 7, 9}, "uttar pradesh"),
    ("St Louis Park, 500 Elm St, MN", "US", {"elm", "louis", "park", "saint", "street"}, {500}, "minnesota"),
    ("3 Allée des Pins, Ste 4, Lyon, Rhône", "France", {"allee", "lyon", "pins", "suite"}, {3, 4}, "auvergne rhone alpes"),
    ("15 r. St-Honoré, 75001 Paris", "France", {"rue", "saint", "honore", "paris"}, {15, 75001}, ""),
    ("2 BIS RUE X, NANTES", "France", {"rue", "x", "nantes"}, {2}, ""),
    ("12 Ter Rd, TX", "US", {"terrace", "road"}, {12}, "texas"),
    ("Harris County, 4 Elm Rd, TX", "US", {"harris", "elm", "road"}, {4}, "texas"),
    ("5 MG Road, Thane City Corporation, MH", "India", {"mg", "road", "thane"}, {5}, "maharashtra"),
    ("3 rue du Village, Lyon", "France", {"rue", "village", "lyon"}, {3}, ""),
    ("1ST FLOOR, 12 MG ROAD, (OLD NO 94), Bengaluru, Karnataka", "India", {"mg", "road", "bengaluru"}, {12}, "karnataka"),
    ("Old No.15, New No 8, Anna Salai, Chennai", "India", {"new", "anna", "salai", "chennai"}, {8}, ""),
    *((f"{floor}, 7 X Rd, Pune", "India", {"x", "road", "pune"}, {7}, "") for floor in
      ("IIFLOOR", "Fourth Floor", "010Th Floor", "ground floor", "IIND FLOOR", "Floor-2", "upper ground floor", "2nd flr", "Gr Floor", "G Floor")),
]
OFF_NAMES = [("5ervices Regiona1 LLC", "5ervices regiona1"), ("Eye Clinic LLC #74779", "eye clinic 74779"), ("M/s Sharma Traders", "m s sharma traders")]
OFF_ADDRESSES = [
    ("15 r. St-Honoré, 75001 Paris", "France", {"rue", "street", "honore", "paris"}),
    ("2 BIS RUE X, NANTES", "France", {"bis", "rue", "x", "nantes"}),
    ("12 ter rue Y, Lyon", "France", {"terrace", "rue", "y", "lyon"}),
    ("Harris County, 4 Elm Rd, TX", "US", {"harris", "county", "elm", "road"}),
]


def parsed(spark, rows, schema, column):
    return [r["p"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).withColumn("p", column).orderBy("i").collect()]


def test_names(spark):
    got = parsed(spark, [(n,) for n, _, _ in NAMES], "raw string", parse_name(F.col("raw"), F.lit("us")))
    assert [(g["core"], g["legal"]) for g in got] == [(c, f) for _, c, f in NAMES]


def test_name_fields(spark):
    rows = [("Studio 54 Groupe Holdings #12345",), ("Association de Lesperance",), ("Anil Partners Services Downtown",), ("X & Y trading as Blue Sky Ltd",)]
    a, b, c, d = parsed(spark, rows, "raw string", parse_name(F.col("raw"), F.lit("france")))
    assert a["nums"] == [54] and a["gw"] == ["group", "holding"] and b["ini"] == "al"
    assert c["sib"] == ["loc", "partners"] and c["churn"] == ["service"]
    assert (d["core"], d["alt"], d["concat"], d["sorted"]) == ("blue sky", "x y", "blueskyltd", "blue sky")


def test_addresses(spark):
    got = parsed(spark, [(a, c) for a, c, *_ in ADDRESSES], "raw string, c string", parse_address(F.col("raw"), F.col("c")))
    assert [(set(g["tokens"]), set(g["nums"]), g["state"]) for g in got] == [tuple(x[2:]) for x in ADDRESSES]
    assert got[1]["digits"] == "123420062701" and got[6]["empty"] == 1 and got[7]["empty"] == 1


def test_switched_off(spark):
    off = fixes("all")
    got = parsed(spark, [(n,) for n, _ in OFF_NAMES], "raw string", parse_name(F.col("raw"), F.lit("us"), on=off))
    assert [g["core"] for g in got] == [c for _, c in OFF_NAMES]
    got = parsed(spark, [(a, c) for a, c, _ in OFF_ADDRESSES], "raw string, c string", parse_address(F.col("raw"), F.col("c"), on=off))
    assert [set(g["tokens"]) for g in got] == [t for *_, t in OFF_ADDRESSES]
    assert fixes("ms, fr_bis") == frozenset(FIXES) - {"ms", "fr_bis"}
    with pytest.raises(KeyError):
        fixes("ms,bogus")


def test_lexicon_is_scoped(spark):
    lexicon = {"addr_map": {"us": {"saint": "street"}}, "name_map": {"*": {"centre": "center"}}}
    got = parsed(spark, [("Saint-Nazaire, Pays de la Loire", "France"), ("Saint Paul Rd, MN", "US")], "raw string, c string", parse_address(F.col("raw"), F.col("c"), lexicon))
    assert [set(g["tokens"]) for g in got] == [{"saint", "nazaire"}, {"street", "paul", "road"}]
    assert parsed(spark, [("Eye Centre",)], "raw string", parse_name(F.col("raw"), F.lit("us"), lexicon))[0]["core"] == "eye center"


def test_phonetic_key(spark):
    words = ["phone", "fone", "shri", "sri", "qazi", "ghee", "ayush", "hh", "xavier", "", "banana"]
    keys = parsed(spark, [(w,) for w in words], "w string", text.phonetic_key(F.col("w")))
    assert keys == ["fn", "fn", "sr", "sr", "ks", "g", "as", "h", "ksvr", "", "bn"]


def test_transliteration_drops_the_last_inherent_vowel():
    assert text.transliterate("राम नगर ५") == "ram nagar 5"
    assert text.transliterate("फ़ोन") == "fon"
    assert text.fold("Œuvre Straße №5") == "oeuvre strasse no5"
