from tallyloom.sources.tables import current_rows, load, lines_in_force, lists_in_force, postings_in_force, ranks_in_force
from tallyloom.sources.text import adjacency_text, key_value_file, lines_with_offset, tweets_tsv

__all__ = [
    "adjacency_text",
    "current_rows",
    "key_value_file",
    "lines_in_force",
    "lines_with_offset",
    "lists_in_force",
    "load",
    "postings_in_force",
    "ranks_in_force",
    "tweets_tsv",
]
