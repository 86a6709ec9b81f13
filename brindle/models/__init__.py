"""Price models: design matrix, text weights, boosted trees, quantile net, training grid, stored versions."""
