"""Column expressions: everything here is row-wise and stays inside the plan."""
