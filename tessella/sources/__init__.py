"""Where triples come from."""

from .collection import triples_from_rows, triples_schema
from .random_graph import random_stream, random_triples
from .trips import TRIP_SCHEMA, read_trips, trips_to_triples
from .tweets import in_box, read_tweets, tweets_to_triples

__all__ = [
    "TRIP_SCHEMA", "in_box", "random_stream", "random_triples", "read_trips", "read_tweets", "triples_from_rows",
    "triples_schema", "trips_to_triples", "tweets_to_triples",
]
