"""Project retrieval, comparison and staffing analytics as composable DataFrame operators."""
