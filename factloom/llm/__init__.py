"""Operations for training-data pipelines: ten DataFrame operators and their queries."""
