from .hashing import hash_hex, hash_uint32, seed_draw, uniform
from .numeric import exact_minor_units, half_even_share, minor_units, ordered_bucket

__all__ = ["hash_hex", "hash_uint32", "uniform", "seed_draw", "minor_units", "exact_minor_units", "half_even_share", "ordered_bucket"]
