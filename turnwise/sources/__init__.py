"""Reading and writing: conversations, splits, requests and responses, results, metrics, word vectors."""
