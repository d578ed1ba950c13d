"""Made-up prose for the tests."""


def words_text(rng, n):
    """n words in sentences of 2 to 14 words."""
    out, left = [], rng.randint(2, 14)
    for i in range(n):
        word = "".join(rng.choice("aeioubdglmnprst") for _ in range(rng.randint(2, 8)))
        left -= 1
        if left <= 0 or i == n - 1:
            word, left = word + rng.choice(".!?"), rng.randint(2, 14)
        out.append(word)
    return " ".join(out)
