from tallyloom.functions.codec import decode_postings, encode_postings
from tallyloom.functions.postfix import parse_postfix
from tallyloom.functions.tokens import alphabetic, distinct_tokens, tokens

__all__ = ["alphabetic", "decode_postings", "distinct_tokens", "encode_postings", "parse_postfix", "tokens"]
