"""Training-data operators: ten document-scale stages and their registered queries."""
