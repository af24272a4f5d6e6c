"""What tests of the text operators share."""

#: Columns of the input with names that operators use themselves.
CLASHES = ["text_key", "n_words", "n_hit", "ids", "decoded", "host", "path", "rule", "verdict", "kept", "cleaned", "spans", "gone", "_row",
           "root", "key_a", "body", "line", "replaced", "n_lines", "n_removed", "score", "lang_pred", "_found", "_words", "_text_key", "n", "grp"]
LONG = " ".join(f"w{i % 7919}x{i % 13}" for i in range(60_000))


def prose(rng, words=40, vocabulary=300):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(vocabulary)}" for _ in range(words))
