"""Word tables of the normalisers.

Fixed values: results depend on every entry.
"""

NAME_REMOVED = (
    "corporation incorporated limited company companies private enterprises enterprise industries industry international associates brothers "
    "the ltd pvt llc inc corp co gmbh sa sas srl bv plc group holdings services solutions technologies tech intl global national assoc bros ent ind"
).split()
NAME_AND = "and"  # becomes "&", which names drop

ADDRESS_WORDS = {
    "road": "rd", "street": "st", "avenue": "ave", "boulevard": "blvd", "lane": "ln", "drive": "dr", "court": "ct", "circle": "cir", "highway": "hwy",
    "apartment": "apt", "apartments": "apt", "building": "bldg", "floor": "fl", "suite": "ste", "sector": "sec", "block": "blk", "colony": "col",
    "nagar": "ngr", "cross": "x", "north": "n", "south": "s", "east": "e", "west": "w", "post": "po", "office": "off",
    "near": "near", "opposite": "near", "opp": "near", "behind": "near",
}

NAME_STOPWORDS = (
    "& co the of a an ltd pvt llc inc corp gmbh sa sas srl bv plc group holdings services solutions technologies tech intl global national assoc bros "
    "ent ind corporation incorporated limited company companies private enterprises enterprise industries industry international associates brothers "
    "india indian usa us uk canada australia"
).split()

ADDRESS_STOPWORDS = (
    "no rd st dr ave new fl city a n c s w e h p l b m x y z ngr col blk sec blvd ln ct cir hwy apt bldg ste po off 0 1 2 3 4 5 6 7 8 9 near nan null unit plot o d"
).split()
