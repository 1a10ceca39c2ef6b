"""The workload: pattern sets over the triples view of the sales tables."""

from tripleweave.functions.terms import RDF_TYPE as TYPE

W1 = [("?x", TYPE, "<Order>"), ("?x", "<placedBy>", "<customer/7>")]
W2 = [
    ("?ord", TYPE, "<Order>"),
    ("?part", TYPE, "<Part>"),
    ("?sup", TYPE, "<Supplier>"),
    ("?ord", "<contains>", "?part"),
    ("?part", "<soldBy>", "?sup"),
    ("?ord", "<suppliedBy>", "?sup"),
]
# Over materialised triples: no table states <Party> or <locatedIn>.
W3 = [("?x", TYPE, "<Party>"), ("?x", "<locatedIn>", "<nation/3>")]
W4 = [
    ("?x", "<placedBy>", "<customer/7>"),
    ("?x", "<status>", "?y1"),
    ("?x", "<priority>", "?y2"),
    ("?x", "<shipFlag>", "?y3"),
]
W5 = [("?x", TYPE, "<Customer>"), ("?x", "<fromNation>", "<nation/3>")]
W6 = [("?x", TYPE, "<Supplier>")]
W7 = [("?x", "<contains>", "?y"), ("<order/1>", "<contains>", "?y")]
W8 = [
    ("?x", "<placedBy>", "?y"),
    ("?y", "<fromNation>", "<nation/3>"),
    ("?x", "<priority>", "?z"),
]
W9 = [
    ("?ord", "<contains>", "?part"),
    ("?part", "<soldBy>", "?sup"),
    ("?ord", "<suppliedBy>", "?sup"),
]
W10 = [("?x", TYPE, "<Order>"), ("?x", "<placedBy>", "<customer/8>")]
W12 = [
    ("?x", TYPE, "<Order>"),
    ("?y", TYPE, "<Customer>"),
    ("?x", "<placedBy>", "?y"),
    ("?y", "<fromNation>", "<nation/3>"),
]
WTOY = [("?x", "<fromNation>", "?y"), ("?z", "<placedBy>", "?x")]
CYCLE = [
    ("?ord", "<placedBy>", "?cust"),
    ("?cust", "<fromNation>", "?nat"),
    ("?sup", "<basedIn>", "?nat"),
    ("?ord", "<suppliedBy>", "?sup"),
]

WORKLOAD = {
    "w1": W1, "w2": W2, "w3": W3, "w4": W4, "w5": W5, "w6": W6, "w7": W7,
    "w8": W8, "w9": W9, "w10": W10, "w12": W12, "wtoy": WTOY, "cycle_match": CYCLE,
}
