"""Column functions: declared types, strict and lenient JSON decoding, encoding, keys and buckets."""
