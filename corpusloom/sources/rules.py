"""A catalog of code cycles and their books that follows from rules, seed rows, and the list of chapters that stands in where a contents page can't be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Authority; first and last year of its cycles and the step; years from the cycle's to the one in which it takes effect; month of effect; name of a cycle ({y}: its year, {yy}: the last two digits).
FAMILIES = [
    ("California", 2010, 2025, 3, 1, 1, "{y} California Building Standards Code (Title 24)"),
    ("ICC", 2009, 2024, 3, 0, 1, "{y} International Codes (I-Codes)"),
    ("NFPA 70", 2008, 2023, 3, 0, 1, "{y} National Electrical Code (NFPA 70)"),
    ("IAPMO", 2009, 2024, 3, 0, 1, "{y} Uniform Plumbing and Mechanical Codes"),
    ("ASHRAE 90.1", 2010, 2022, 3, 0, 10, "ANSI/ASHRAE/IES Standard 90.1-{y}"),
    ("ASHRAE 189.1", 2011, 2023, 3, 0, 10, "ANSI/ASHRAE/USGBC/IES Standard 189.1-{y}"),
    ("ASCE 7", 2010, 2022, 6, 0, 6, "ASCE/SEI 7-{yy} Minimum Design Loads"),
    ("NFPA 13", 2010, 2025, 3, 0, 1, "NFPA 13-{y} Standard for the Installation of Sprinkler Systems"),
    ("NFPA 72", 2010, 2025, 3, 0, 1, "NFPA 72-{y} National Fire Alarm and Signaling Code"),
    ("NFPA 101", 2009, 2024, 3, 0, 1, "NFPA 101-{y} Life Safety Code"),
    ("NFPA 54", 2009, 2024, 3, 0, 1, "NFPA 54-{y} National Fuel Gas Code"),
    ("NFPA 58", 2008, 2023, 3, 0, 1, "NFPA 58-{y} Liquefied Petroleum Gas Code"),
]
# Authority, part, abbreviation, name, model code it builds on, first year. An authority that isn't here has one book a cycle, named as the cycle.
BOOKS = [
    ("California", "Part 1", "CAC", "California Administrative Code", None, 2010),
    ("California", "Part 2", "CBC", "California Building Code", "IBC", 2010),
    ("California", "Part 2.5", "CRC", "California Residential Code", "IRC", 2010),
    ("California", "Part 3", "CEC", "California Electrical Code", "NEC", 2010),
    ("California", "Part 4", "CMC", "California Mechanical Code", "UMC", 2010),
    ("California", "Part 5", "CPC", "California Plumbing Code", "UPC", 2010),
    ("California", "Part 6", "CEnergy", "California Energy Code", None, 2010),
    ("California", "Part 8", "CHBC", "California Historical Building Code", None, 2010),
    ("California", "Part 9", "CFC", "California Fire Code", "IFC", 2010),
    ("California", "Part 10", "CEBC", "California Existing Building Code", "IEBC", 2016),
    ("California", "Part 11", "CALGreen", "California Green Building Standards Code", None, 2010),
    ("California", "Part 12", "CRSC", "California Referenced Standards Code", None, 2010),
    ("ICC", None, "IBC", "International Building Code", None, 2009),
    ("ICC", None, "IRC", "International Residential Code", None, 2009),
    ("ICC", None, "IFC", "International Fire Code", None, 2009),
    ("ICC", None, "IEBC", "International Existing Building Code", None, 2009),
    ("ICC", None, "IMC", "International Mechanical Code", None, 2009),
    ("ICC", None, "IPC", "International Plumbing Code", None, 2009),
    ("ICC", None, "IECC", "International Energy Conservation Code", None, 2009),
    ("ICC", None, "IgCC", "International Green Construction Code", None, 2012),
    ("IAPMO", None, "UPC", "Uniform Plumbing Code", None, 2009),
    ("IAPMO", None, "UMC", "Uniform Mechanical Code", None, 2009),
]
# Where books can be read, and the years of which they can, by authority.
CONTENT, PUBLIC = "https://codes.iccsafe.org/content", {"California": (2022, 2025), "ICC": (2021, 2024)}
# Chapters of the model building code, from 1.
CHAPTERS = """Scope and Administration|Definitions|Use and Occupancy Classification|Special Detailed Requirements|General Building Heights and Areas|Types of Construction|Fire and Smoke Protection Features|Interior Finishes|Fire Protection and Life Safety Systems|Means of Egress|Accessibility|Interior Environment|Energy Efficiency|Exterior Walls|Roof Assemblies and Rooftop Structures|Structural Design|Special Inspections and Tests|Soils and Foundations|Concrete|Aluminum|Masonry|Steel|Wood|Glass and Glazing|Gypsum Board, Gypsum Panel Products and Plaster|Plastic|Electrical|Mechanical Systems|Plumbing Systems|Elevators and Conveying Systems|Special Construction|Encroachments Into The Public Right-Of-Way|Safeguards During Construction|Existing Buildings and Structures|Referenced Standards""".split("|")
# Fixed value: the one chapter whose address says more than its title.
LONGER_ADDRESS = {4: "special-detailed-requirements-based-on-use-and-occupancy"}
# Publishing organisations, and standards that texts refer to.
ORGANISATIONS = [("ICC", "International Code Council"), ("NFPA", "National Fire Protection Association"), ("IAPMO", "International Association of Plumbing and Mechanical Officials"), ("CBSC", "California Building Standards Commission")]
STANDARDS = [("ASTM E119", 2020), ("ASTM E84", 2020), ("NFPA 13", 2022), ("NFPA 72", 2022), ("NFPA 101", 2021), ("NFPA 70", 2020), ("ACI 318", 2019), ("AISC 360", 2016), ("ASCE 7", 2022), ("ASHRAE 62.1", 2022)]


def cycles(spark: SparkSession) -> DataFrame:
    """(authority, year, name, effective, expires, status): each cycle is superseded when the next takes effect, the last one is active."""
    rows = spark.createDataFrame(FAMILIES, "authority string, first int, last int, step int, delay int, month int, pattern string")
    each = rows.withColumn("year", F.explode(F.sequence("first", "last", "step")))
    day = lambda y: F.make_date(y + F.col("delay"), F.col("month"), F.lit(1))
    final = F.col("year") == F.col("last")
    name = F.replace(F.replace("pattern", F.lit("{yy}"), F.substring(F.col("year").cast("string"), 3, 2)), F.lit("{y}"), F.col("year").cast("string"))
    return each.select("authority", "year", name.alias("name"), day(F.col("year")).alias("effective"), F.when(~final, day(F.col("year") + F.col("step"))).alias("expires"), F.when(final, "active").otherwise("superseded").alias("status"))


def base_year(authority: Column, model: Column, year: Column) -> Column:
    """The year of the model code that a part builds on: the electrical code's is two years before the part's, the others' one."""
    return F.when((authority == "California") & model.isNotNull(), year - F.when(model == "NEC", 2).otherwise(1))


def address(authority: Column, abbreviation: Column, part: Column, year: Column) -> Column:
    """Where a book can be read; null where it isn't public. A part's address ends in its number, and the building code has volumes."""
    where = F.concat(F.lit(f"{CONTENT}/"), abbreviation, year.cast("string"))
    number = F.replace(F.replace(part, F.lit("Part "), F.lit("P")), F.lit("."), F.lit("_"))
    return F.when((authority == "California") & year.isin(*PUBLIC["California"]), F.concat(where, number, F.when(abbreviation == "CBC", "V1").otherwise(""))).when((authority == "ICC") & year.isin(*PUBLIC["ICC"]), where)


def books(spark: SparkSession) -> DataFrame:
    """(authority, year, part, abbreviation, name, model, base_year, url, status) of every book of every cycle."""
    known = spark.createDataFrame(BOOKS, "authority string, part string, abbreviation string, title string, model string, since int")
    joined = cycles(spark).join(F.broadcast(known), "authority", "left").filter("since IS NULL OR year >= since")
    year = F.col("year").cast("string")
    name = F.when(F.col("title").isNull(), F.col("name")).otherwise(F.concat_ws(" — ", F.concat_ws(" ", year, "title"), "part"))
    return joined.select("authority", "year", "part", F.coalesce("abbreviation", "authority").alias("abbreviation"), name.alias("name"), "model", base_year(F.col("authority"), F.col("model"), F.col("year")).alias("base_year"), address(F.col("authority"), F.col("abbreviation"), F.col("part"), F.col("year")).alias("url"), "status")


def fallback_chapters(spark: SparkSession, url: str) -> DataFrame:
    """(number, title, url) of the chapters of a code at ``url``."""
    rows = spark.createDataFrame([(k, t, LONGER_ADDRESS.get(k)) for k, t in enumerate(CHAPTERS, 1)], "number int, title string, longer string")
    slug = F.coalesce("longer", F.lower(F.regexp_replace(F.replace("title", F.lit(","), F.lit("")), " ", "-")))
    n = F.col("number").cast("string")
    return rows.select("number", F.concat(F.lit("Chapter "), n, F.lit(" - "), "title").alias("title"), F.concat(F.lit(url.rstrip("/") + "/chapter-"), n, F.lit("-"), slug).alias("url"))
