def text_of(words):
    return " ".join(words)
