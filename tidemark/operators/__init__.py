"""Operations on bags of rows with signed multiplicities."""
