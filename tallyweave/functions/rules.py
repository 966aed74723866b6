"""The ordered rules of the enhanced normal form, as data."""

from __future__ import annotations

# Patterns, replacements and their order are the contract of the enhanced normal form.
RULES_BY_KIND: dict[str, tuple[tuple[str, str], ...]] = {
    "abbreviation": (
        (r"\bOZ\b", r"OUNCE"),
        (r"\bPK\b", r"PACK"),
        (r"\bCT\b", r"COUNT"),
        (r"\bBTL\b", r"BOTTLE"),
        (r"\bCN\b", r"CAN"),
        (r"\bCS\b", r"CASE"),
        (r"\bLTR\b", r"LITER"),
        (r"\bGAL\b", r"GALLON"),
        (r"\bLB\b", r"POUND"),
        (r"\bKG\b", r"KILOGRAM"),
        (r"\bML\b", r"MILLILITER"),
        (r"\bMG\b", r"MILLIGRAM"),
        (r"\bG\b", r"GRAM"),
        (r"\bSM\b", r"SMALL"),
        (r"\bMED\b", r"MEDIUM"),
        (r"\bLG\b", r"LARGE"),
        (r"\bXL\b", r"EXTRA LARGE"),
        (r"\bREG\b", r"REGULAR"),
        (r"\bORG\b", r"ORGANIC"),
        (r"\bNAT\b", r"NATURAL"),
        (r"\bFLVR\b", r"FLAVOR"),
        (r"\bASSTD\b", r"ASSORTED"),
        (r"\bVAR\b", r"VARIETY"),
        (r"\bCHOC\b", r"CHOCOLATE"),
        (r"\bVAN\b", r"VANILLA"),
        (r"\bSTRW\b", r"STRAWBERRY"),
        (r"\bBLU\b", r"BLUE"),
        (r"\bGRN\b", r"GREEN"),
        (r"\bYEL\b", r"YELLOW"),
        (r"\bORNGE\b", r"ORANGE"),
    ),
    "unit": (
        (r"(\d+)\s*OUNCE", r"\1OZ"),
        (r"(\d+)\s*PACK", r"\1PK"),
        (r"(\d+)\s*COUNT", r"\1CT"),
        (r"(\d+)\s*LITER", r"\1L"),
        (r"(\d+)\s*GALLON", r"\1GAL"),
        (r"(\d+)\s*POUND", r"\1LB"),
        (r"(\d+)\.(\d+)OZ", r"\1-\2OZ"),
        (r"(\d+)/(\d+)OZ", r"\1PK \2OZ"),
        (r"(\d+)\s*-\s*PACK", r"\1PK"),
        (r"(\d+)\s*PC", r"\1CT"),
    ),
    "typo": (
        (r"\bSNICKRS\b", r"SNICKERS"),
        (r"\bCHIKEN\b", r"CHICKEN"),
        (r"\bTENDRS\b", r"TENDERS"),
        (r"\bTNDRS\b", r"TENDERS"),
        (r"\bCHEEZE\b", r"CHEESE"),
        (r"\bCHILLI\b", r"CHILI"),
        (r"\bDASANNI\b", r"DASANI"),
        (r"\bCOCACOLA\b", r"COCA-COLA"),
        (r"\bCOCA_COLA\b", r"COCA-COLA"),
    ),
    "brand": (
        (r"\bCOCA COLA\b", r"COCA-COLA"),
        (r"\bCOKE CL\b", r"COCA-COLA CLASSIC"),
        (r"\bCC CLASSIC\b", r"COCA-COLA CLASSIC"),
        (r"\bDR PEPPER\b", r"DR. PEPPER"),
        (r"\bDR\.PEPPER\b", r"DR. PEPPER"),
        (r"\bMTN DEW\b", r"MOUNTAIN DEW"),
        (r"\bMT DEW\b", r"MOUNTAIN DEW"),
        (r"\bMNTN DEW\b", r"MOUNTAIN DEW"),
        (r"\bPPSI\b", r"PEPSI"),
        (r"\bPEPSI COLA\b", r"PEPSI"),
        (r"\bPEPSI-COLA\b", r"PEPSI"),
        (r"\bFRITO LAY\b", r"FRITO-LAY"),
        (r"\bFRTO LY\b", r"FRITO-LAY"),
        (r"\bFL CLASSIC\b", r"FRITO-LAY CLASSIC"),
        (r"\bDRTS\b", r"DORITOS"),
        (r"\bDORI\b", r"DORITOS"),
        (r"\bLAYS\b", r"LAY'S"),
        (r"\bLYS\b", r"LAY'S"),
        (r"\bGTRD\b", r"GATORADE"),
        (r"\bGTRDE\b", r"GATORADE"),
        (r"\bAQF\b", r"AQUAFINA"),
        (r"\bAQUA\b", r"AQUAFINA"),
        (r"\bNSTL\b", r"NESTLE"),
        (r"\bSNYDERS\b", r"SNYDER'S"),
        (r"\bSNDRS\b", r"SNYDER'S"),
    ),
    "variant": (
        (r"\bORIG\b", r"ORIGINAL"),
        (r"\bORGNL\b", r"ORIGINAL"),
        (r"\bCLS\b", r"CLASSIC"),
        (r"\bCLSC\b", r"CLASSIC"),
        (r"\bNCH\b", r"NACHO"),
        (r"\bCHS\b", r"CHEESE"),
        (r"\bCHSE\b", r"CHEESE"),
        (r"\bFRT\b", r"FRUIT"),
        (r"\bPNCH\b", r"PUNCH"),
        (r"\bHNY\b", r"HONEY"),
        (r"\bMSTRD\b", r"MUSTARD"),
        (r"\bPRTZL\b", r"PRETZEL"),
        (r"\bPTO\b", r"POTATO"),
        (r"\bCHP\b", r"CHIP"),
        (r"\bCHPS\b", r"CHIPS"),
        (r"\bWTR\b", r"WATER"),
        (r"\bPUR\b", r"PURE"),
        (r"\bLF\b", r"LIFE"),
        (r"\bSPRNG\b", r"SPRING"),
        (r"\bMX\b", r"MIX"),
    ),
    "punctuation": (
        (r",", r" "),
        (r";", r" "),
        (r":", r" "),
        (r"/", r" "),
        (r"\(", r" "),
        (r"\)", r" "),
        (r"\[", r" "),
        (r"\]", r" "),
        (r"#", r""),
        (r"\*", r""),
    ),
    "category": (
        (r"\bBEVERAGE\b", r"BEVERAGES"),
        (r"\bSNACK\b", r"SNACKS"),
        (r"\bCONDIMENT\b", r"CONDIMENTS"),
        (r"\bPREP FOOD\b", r"PREPARED FOODS"),
        (r"\bPREP FD\b", r"PREPARED FOODS"),
        (r"\bBEV\b", r"BEVERAGES"),
        (r"\bSNK\b", r"SNACKS"),
    ),
    "whitespace": (
        (r"\s+", r" "),
        (r"^\s+", r""),
        (r"\s+$", r""),
    ),
}
# The priority that each kind is listed with. The order above decides, not the number.
PRIORITIES = {"abbreviation": 10, "unit": 20, "typo": 12, "brand": 30, "variant": 35, "punctuation": 40, "category": 50, "whitespace": 90}

RULES: list[tuple[str, str, str]] = [(kind, pattern, with_) for kind, some in RULES_BY_KIND.items() for pattern, with_ in some]
