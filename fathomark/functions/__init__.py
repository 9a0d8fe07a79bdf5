"""Types, decimals, temporal values and Column builders."""
