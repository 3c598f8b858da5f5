"""Five answer graphs over 13 concepts with their known scores (four decimals)."""

from causeway.operators import graph_metrics as M

TRUTH = [(0, 1), (1, 2), (2, 3), (2, 5), (4, 2), (4, 5), (6, 7), (8, 10), (9, 10), (11, 12)]
# The predicted edges of five models.
PREDICTED = [
    [(0, 1), (0, 2), (0, 9), (1, 2), (2, 0), (2, 1), (2, 11), (2, 12), (4, 2), (4, 7), (4, 12), (5, 2), (6, 2), (7, 2), (8, 9), (8, 10), (9, 2), (9, 8), (11, 10), (11, 12)],
    [(0, 2), (1, 7), (2, 0), (2, 1), (2, 5), (2, 6), (2, 7), (4, 1), (4, 2), (4, 12), (8, 10), (9, 0), (9, 1), (9, 8), (9, 10), (11, 12)],
    [(1, 2), (1, 7), (2, 0), (2, 1), (2, 7), (4, 2), (4, 7), (5, 7), (6, 7), (8, 9), (8, 10), (9, 0), (9, 1), (9, 10), (11, 7)],
    [(0, 1), (1, 2), (1, 7), (1, 9), (2, 0), (2, 6), (2, 7), (2, 10), (4, 1), (4, 2), (4, 5), (4, 7), (8, 10), (9, 6), (9, 7), (9, 10), (11, 7), (11, 12)],
    [(1, 2), (1, 6), (1, 7), (2, 4), (2, 5), (2, 7), (4, 2), (8, 10), (9, 1), (9, 10), (11, 12)],
]
# Their scores, in the order of the models.
SCORES = {
    "tp": [5, 5, 5, 7, 6], "fp": [15, 11, 10, 11, 5], "fn": [5, 5, 5, 3, 4], "tn": [131, 135, 136, 135, 141],
    "adj_precision": [0.3529, 0.4, 0.3571, 0.3889, 0.6], "adj_recall": [0.6, 0.6, 0.5, 0.7, 0.6], "adj_f1": [0.4444, 0.48, 0.4167, 0.5, 0.6],
    "ori_precision_full": [0.25, 0.3125, 0.3333, 0.3889, 0.5455], "ori_recall_full": [0.5, 0.5, 0.5, 0.7, 0.6], "ori_f1_full": [0.3333, 0.3846, 0.4, 0.5, 0.5714],
    "shd_breakdown": [19, 15, 15, 14, 9], "shd_additions": [14, 10, 10, 11, 5], "shd_deletions": [4, 4, 5, 3, 4], "shd_reversals": [1, 1, 0, 0, 0],
    "skeleton_shd": [15, 13, 14, 14, 8], "accuracy": [0.8718, 0.8974, 0.9038, 0.9103, 0.9423], "balanced_accuracy": [0.6986, 0.7123, 0.7158, 0.8123, 0.7829],
    "mcc": [0.2910, 0.3428, 0.3585, 0.4789, 0.5413], "fdr": [0.75, 0.6875, 0.6667, 0.6111, 0.4545], "specificity": [0.8973, 0.9247, 0.9315, 0.9247, 0.9658],
    "fpr": [0.1027, 0.0753, 0.0685, 0.0753, 0.0342], "fnr": [0.5, 0.5, 0.5, 0.3, 0.4], "exact_match": [0, 0, 0, 0, 0],
}


def test_known_scores(spark):
    graphs = spark.createDataFrame([(k,) for k in range(5)], "k INT")
    true = spark.createDataFrame([(k, i, j) for k in range(5) for i, j in TRUTH], "k INT, i INT, j INT")
    pred = spark.createDataFrame([(k, i, j) for k, edges in enumerate(PREDICTED) for i, j in edges], "k INT, i INT, j INT")
    got = {r.k: r for r in M.all_metrics(graphs, true, pred, "k", 13).collect()}
    for name, values in SCORES.items():
        assert [round(got[k][name], 4) for k in range(5)] == values, name
