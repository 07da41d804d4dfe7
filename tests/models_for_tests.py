"""Models as a user brings them: a function that gives a function of contexts and texts."""


def labeler(num_beams=1):
    return lambda contexts, texts: [f"{c.rsplit(' ', 1)[1]}, with {num_beams} beams. " for c in contexts]


def embedder():
    return lambda contexts, texts: [[float(len(t)), float(len(c))] for c, t in zip(contexts, texts)]


def scorer():
    return lambda contexts, texts: [-0.01 * len(c) - len(t) for c, t in zip(contexts, texts)]
