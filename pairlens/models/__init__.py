"""The matching models, each a composition of operators over DataFrames. Every model gives (key, score or qtile, confidence, class)."""
