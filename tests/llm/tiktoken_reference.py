"""The library's encoding of a rank file, to compare with."""

import base64

import tiktoken


def encoding(file, pattern):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
