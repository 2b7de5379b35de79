"""Operations for building training corpora, each one module with its query beside it."""
