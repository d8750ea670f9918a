"""Small graphs for the tests, as plain Python rows."""

import datetime as dt

V_KIND, E_KIND = "Relevance INT, Size INT, Weekday STRING", "Weekday STRING, Weight INT"
LABELS = {"v1": "A", "v2": "B", "v3": "A", "v4": "B", "v5": "A", "v6": "B", "v7": "A", "v8": "B"}
VERTICES = {
    "v1": (1, 15, "Monday"), "v2": (3, 10, None), "v3": (2, 30, "Monday"), "v4": (5, 5, "Thursday"),
    "v5": (2, None, "Monday"), "v6": (3, 10, None), "v7": (2, 30, "Monday"), "v8": (5, 5, "Thursday"),
}
EDGES = [
    ("e1", "impacts", ("Thursday", None), "v1", "v2"), ("e2", "impacts", (None, 6), "v3", "v4"), ("e3", "calculates", ("Thursday", 3), "v3", "v4"),
    ("e4", "impacts", ("Thursday", None), "v1", "v2"), ("e5", "impacts", (None, 6), "v5", "v6"), ("e6", "calculates", ("Thursday", 3), "v5", "v6"),
    ("e7", "impacts", ("Thursday", None), "v7", "v8"), ("e8", "impacts", (None, 6), "v7", "v8"),
]
FIRST, SECOND = 1619511660000, 1619511670000


def at(ms):
    return dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(milliseconds=ms)


def vertex(v, ms):
    return v, LABELS[v], VERTICES[v], at(ms)


def unit_rows():
    """Two instants ten seconds apart, one for each half of the vertices."""
    when = lambda v: FIRST if v in ("v1", "v2", "v3", "v4") else SECOND
    return [(e, at(when(s)), label, p, vertex(s, when(s)), vertex(t, when(t))) for e, label, p, s, t in EDGES]


def demo_rows():
    """Four instants; e9 lies in the first window, its vertices only in the second."""
    time = {"v1": 1, "v2": 1, "v3": 2, "v4": 2, "v5": 13, "v6": 13, "v7": 14, "v8": 14}
    edge_time = {"e1": 1, "e2": 1, "e3": 2, "e4": 2, "e5": 13, "e6": 13, "e7": 14, "e8": 14, "e9": 1}
    ms = lambda s: FIRST + 1000 * s
    edges = [*EDGES, ("e9", "calculates", ("Thursday", 3), "v7", "v8")]
    return [(e, at(ms(edge_time[e])), label, p, vertex(s, ms(time[s])), vertex(t, ms(time[t]))) for e, label, p, s, t in edges]
