"""Golden joint label counts (ground_truth/annotator1/annotator2 -> n) of two shipped
annotation datasets, and the values computed from them (fixed values)."""

D1 = {
    ("negative", "negative", "negative"): 49, ("negative", "negative", "neutral"): 2,
    ("negative", "negative", "positive"): 3, ("negative", "neutral", "negative"): 1,
    ("negative", "neutral", "positive"): 1, ("negative", "positive", "positive"): 1,
    ("neutral", "negative", "negative"): 2, ("neutral", "negative", "neutral"): 3,
    ("neutral", "neutral", "negative"): 3, ("neutral", "neutral", "neutral"): 36,
    ("neutral", "neutral", "positive"): 2, ("neutral", "positive", "neutral"): 2,
    ("neutral", "positive", "positive"): 1, ("positive", "negative", "negative"): 1,
    ("positive", "negative", "neutral"): 1, ("positive", "negative", "positive"): 1,
    ("positive", "positive", "negative"): 1, ("positive", "positive", "positive"): 40,
}
D2 = {
    ("anger", "anger", "anger"): 13, ("happiness", "happiness", "happiness"): 28,
    ("happiness", "happiness", "intense emotions"): 2, ("happiness", "happiness", "neutral"): 5,
    ("happiness", "happiness", "sadness"): 1, ("happiness", "intense emotions", "happiness"): 2,
    ("happiness", "intense emotions", "intense emotions"): 1, ("happiness", "neutral", "intense emotions"): 1,
    ("happiness", "neutral", "neutral"): 2, ("intense emotions", "happiness", "happiness"): 3,
    ("intense emotions", "happiness", "intense emotions"): 1, ("intense emotions", "intense emotions", "happiness"): 7,
    ("intense emotions", "intense emotions", "intense emotions"): 11,
    ("intense emotions", "intense emotions", "sadness"): 5, ("intense emotions", "neutral", "neutral"): 2,
    ("neutral", "anger", "neutral"): 1, ("neutral", "intense emotions", "neutral"): 1,
    ("neutral", "neutral", "intense emotions"): 2, ("neutral", "neutral", "neutral"): 13,
    ("neutral", "neutral", "sadness"): 1, ("sadness", "anger", "anger"): 1, ("sadness", "anger", "sadness"): 1,
    ("sadness", "intense emotions", "sadness"): 3, ("sadness", "sadness", "anger"): 2,
    ("sadness", "sadness", "intense emotions"): 1, ("sadness", "sadness", "neutral"): 1,
    ("sadness", "sadness", "sadness"): 39,
}
# (dataset, pair) -> (correct, accuracy n, f1 macro, f1 weighted, kappa)
METRICS = {
    ("d1", "ground_truth", "annotator1"): (136, 0.906739, 0.906296, 0.858861),
    ("d1", "ground_truth", "annotator2"): (132, 0.880211, 0.880000, 0.819265),
    ("d1", "annotator1", "annotator2"): (130, 0.865051, 0.866559, 0.798238),
    ("d2", "ground_truth", "annotator1"): (131, 0.863966, 0.875168, 0.835260),
    ("d2", "ground_truth", "annotator2"): (113, 0.740697, 0.743783, 0.677532),
    ("d2", "annotator1", "annotator2"): (113, 0.743527, 0.741868, 0.681016),
}
# McNemar annotator1 vs annotator2, truth = ground_truth
MCNEMAR = {"d1": (125, 11, 7, 7, 7.0, 0.48068237), "d2": (104, 27, 9, 10, 9.0, 0.003933173)}
